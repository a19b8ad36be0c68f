"""Ticket-event payload parsing (ST2, F6, F11, F12) as column expressions only.

Two payload shapes arrive: the flat form ``{ticket_id, from_agent, body_text, subject}``
with string values, and a nested ``event.object`` / ``data.object`` form. The rules:

* flat ``ticket_id`` (empty/missing -> 0) and ``body_text`` (empty/missing -> "");
* only when **both** are empty, read the nested object: ``id``; first message
  ``body_text`` or else ``body_html``; else the object's ``subject``;
* still no text -> top-level ``subject``;
* HTML tags -> one space each (only if the text holds ``<``), strip;
* ticket id parsed as an integer, failure -> 0; text stripped, then cut to 512.

A document is one JSON object with nothing but JSON white space around it; of a repeated key
the last value counts; a number that is no integer literal (12.0) is cut to one.

Empty strings count as missing everywhere (the reference chains ``or``), hence the
``nullif(x, '')`` before every ``coalesce``. Malformed JSON or a non-object document
is flagged ``malformed`` so the job can route it to a quarantine table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwise.functions import text as tx
from tagwise.taxonomy import MAX_TEXT_LENGTH


# Three parses in all: the document's typed fields (of a nested object its JSON text), the
# nested ticket object, and the id as a number. Each result leaves a generator as a column of
# its own, so no later expression or pushed filter holds a parse again.
DOCUMENT = ("struct<ticket_id:string,body_text:string,from_agent:string,subject:string,"
            "event:struct<object:string>,data:struct<object:string>>")
JSON_EDGES = "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$"
TICKET_OBJECT = "struct<id:string,subject:string,messages:array<struct<body_text:string,body_html:string>>>"
NUMBERS = "struct<ticket_id:double,id:double>"


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _bound(df: DataFrame, name: str, **values: Column) -> DataFrame:
    """``df`` with the struct ``name`` of these values, each evaluated once a row: what reads the
    struct stays above the generator that made it."""
    return df.withColumn(name, F.explode(F.array(F.struct(*[c.alias(k) for k, c in values.items()]))))


def parse_ticket_payload(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``malformed, from_agent, ticket_id, text`` parsed from a JSON string column."""
    # One document and nothing else: as the only element of an array, whatever follows its
    # closing brace is a syntax error or a second element. JSON white space around it is none.
    bare = F.regexp_replace(F.col(value_col), JSON_EDGES, "")
    read = _bound(df, "_read", bare=bare, documents=F.from_json(F.concat(F.lit("["), bare, F.lit("]")), f"array<{DOCUMENT}>"))
    whole = F.col("_read.bare").startswith("{") & (F.size("_read.documents") == 1)
    read = _bound(read, "_top", top=F.when(whole, F.get("_read.documents", F.lit(0))))
    top = F.col("_top.top")
    flat_id, flat_text = _nz(top["ticket_id"]), _nz(top["body_text"])
    use_nested = flat_id.isNull() & flat_text.isNull()
    nested = F.coalesce(F.nullif(_nz(top["event"]["object"]), F.lit("{}")), top["data"]["object"])
    read = _bound(read, "_ticket", nested=use_nested, object=F.from_json(F.when(use_nested, nested), TICKET_OBJECT),
                  number=F.from_json(F.when(use_nested, nested).otherwise(F.col("_read.bare")), NUMBERS))
    is_nested, ticket, number = F.col("_ticket.nested"), F.col("_ticket.object"), F.col("_ticket.number")
    first = F.try_element_at(ticket["messages"], F.lit(1))
    nested_text = F.coalesce(_nz(first["body_text"]), _nz(first["body_html"]), _nz(ticket["subject"]))
    raw_text = F.coalesce(F.when(is_nested, nested_text).otherwise(flat_text), _nz(top["subject"]), F.lit(""))
    raw_id = F.when(is_nested, ticket["id"]).otherwise(flat_id)
    value = F.when(is_nested, number["id"]).otherwise(number["ticket_id"])
    # written as an integer, or no JSON number: by its text; a number in another form is cut
    whole_id = F.when(raw_id.rlike("^-?[0-9]+$") | value.isNull(), raw_id).otherwise(value.try_cast("bigint").cast("string"))
    return (read
            .withColumn("malformed", top.isNull())
            .withColumn("from_agent", F.lower(F.coalesce(top["from_agent"], F.lit(""))) == "true")
            .withColumn("ticket_id", tx.safe_bigint(F.coalesce(whole_id, F.lit("0"))))
            .withColumn("text", tx.truncate(tx.strip(tx.strip_html(raw_text)), MAX_TEXT_LENGTH))
            .drop("_read", "_top", "_ticket"))


def sql_parse_ticket_payload(v: str) -> dict[str, str]:
    """DuckDB twin: SQL expressions for ``from_agent, ticket_id, text`` of payload ``v``."""
    def j(e, p):
        return f"json_extract_string({e}, '{p}')"

    def nz(e):
        return f"nullif({e}, '')"

    flat_id, flat_text = nz(j(v, "$.ticket_id")), nz(j(v, "$.body_text"))
    obj = f"coalesce(nullif({nz(f'json_extract({v}, {chr(39)}$.event.object{chr(39)})::VARCHAR')}, '{{}}'), " \
          f"json_extract({v}, '$.data.object')::VARCHAR)"
    nested_text = (f"coalesce({nz(j(obj, '$.messages[0].body_text'))}, "
                   f"{nz(j(obj, '$.messages[0].body_html'))}, {nz(j(obj, '$.subject'))})")
    use_nested = f"({flat_id} IS NULL AND {flat_text} IS NULL)"
    raw_id = f"CASE WHEN {use_nested} THEN {j(obj, '$.id')} ELSE {flat_id} END"
    raw_text = (f"coalesce(CASE WHEN {use_nested} THEN {nested_text} ELSE {flat_text} END, "
                f"{nz(j(v, '$.subject'))}, '')")
    return {
        "from_agent": f"(lower(coalesce({j(v, '$.from_agent')}, '')) = 'true')",
        "ticket_id": tx.sql_safe_bigint(f"coalesce({raw_id}, '0')"),
        "text": f"substr({tx.sql_strip(tx.sql_strip_html(raw_text))}, 1, {MAX_TEXT_LENGTH})",
    }
