"""Operators of a training-data pipeline: near-duplicates, PII, token files, language
model scoring, secrets, language identification, mixing, vector search, line
boilerplate and benchmark decontamination. Nothing else in the library imports this
subpackage; its registered queries are in :mod:`tagwise.llm.queries`."""
