"""tagwise — support-ticket intent analytics expressed as Spark DataFrame jobs.

Subpackages
-----------
functions  column expressions (text normalisation, hashing, payload parsing, HMAC)
sources    table loaders, file sources/sinks, settings change-log snapshots
operators  curation, audit, scoring, evaluation, routing, privacy, billing, usage
plans      the registered queries (Spark DataFrame + equivalent DuckDB SQL)
streaming  Structured Streaming forms of the ticket, counter, window and billing jobs
"""

from tagwise.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
