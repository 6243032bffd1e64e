"""Rows that fail to parse: read permissively, keep the corrupt text, classify it again by exact checks.

Lines: a null, empty or blank line is `not_json`. Records: a null record counts as one without fields (`column_count`).
Extra columns of the input are ignored; repeated rows are classified one by one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.functions.strictjson import loads

RECORD_COLUMNS = [
    "source", "source_session_id", "file_path", "generation", "byte_offset", "line_number",
    "error_kind", "message", "first_seen_at", "last_seen_at", "occurrence_count",
]
ERROR_KINDS = ["invalid_json", "invalid_session_meta", "read_error", "not_file"]

#: JSON as in RFC 8259: what the reader permits beyond it is switched off.
_STRICT = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
    "allowComments": "false",
    "allowSingleQuotes": "false",
    "allowUnquotedFieldNames": "false",
    "allowNonNumericNumbers": "false",
    "allowNumericLeadingZeros": "false",
    "allowBackslashEscapingAnyCharacter": "false",
    "allowUnquotedControlChars": "false",
}


@F.pandas_udf(T.StringType())
def _classify(lines: pd.Series, suspect: pd.Series) -> pd.Series:
    def one(line, doubted):
        if not doubted:
            return None
        if line is None:
            return "not_json"
        try:
            return None if isinstance(loads(line), dict) else "not_object"
        except ValueError:
            return "not_json"

    return pd.Series([one(x, s) for x, s in zip(lines, suspect)], dtype=object)


def line_reason(raw: Column) -> Column:
    """`not_json`, `not_object` or null.

    The reader stops after the first value, so each line is read inside an array and inside an object: text after the
    value can close or go on with one of the two, never with both. Lines that fail in either, or that don't begin with
    a brace, keep their text and are read once more by an exact reader; all others are objects.
    """
    in_array = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), T.ArrayType(T.StringType()), _STRICT)
    in_object = F.from_json(F.concat(F.lit('{"line":'), raw, F.lit("}")), T.StructType([T.StructField("line", T.StringType()), T.StructField("_corrupt", T.StringType())]), _STRICT)
    clean = (
        raw.rlike(r"\A[ \t\r\n]*\{")
        & F.coalesce(F.size(in_array) == 1, F.lit(False))
        & F.coalesce(in_object["_corrupt"].isNull() & in_object["line"].isNotNull(), F.lit(False))
    )
    suspect = ~F.coalesce(clean, F.lit(False))
    return _classify(F.when(suspect, raw), suspect)


def record_fields(raw: Column) -> Column:
    """The 11 text fields of a record, read permissively; `_corrupt` keeps the text of what the reader rejects."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*RECORD_COLUMNS, "_corrupt"]])
    return F.from_csv(
        raw,
        schema.simpleString()[len("struct<") : -1].replace(":", " "),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""},
    )


def _counted(text: Column, least: int = 0) -> Column:
    """ASCII digits up to 2^63-1 and at least `least`."""
    digits = F.regexp_replace(text, r"\A0+(?=[0-9])", "")
    small = (F.length(digits) < 19) | ((F.length(digits) == 19) & (digits <= "9223372036854775807"))
    return F.coalesce(text.rlike(r"\A[0-9]+\z") & small & ((digits != "0") if least else F.lit(True)), F.lit(False))


def _real_time(text: Column) -> Column:
    shape = text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z\z")
    clock = (F.substring(text, 12, 2) <= "23") & (F.substring(text, 15, 2) <= "59") & (F.substring(text, 18, 2) <= "59")
    day = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull()
    return F.coalesce(shape & clock & day, F.lit(False))


def record_reason(raw: Column, fields: Column) -> Column:
    """`quoting`, `column_count`, `value` or null, the first that holds.

    Every enclosed stretch becomes one quote (a doubled quote is two adjacent stretches). What is left is well quoted
    if the number of quotes was even and each quote stands beside quotes, commas or the ends only; commas then part fields.
    """
    bare = F.regexp_replace(raw, '"[^"]*+"', '"')
    odd = F.length(F.regexp_replace(raw, '[^"]++', "")) % 2 == 1
    quoting = odd | bare.rlike('[^,"]"|"[^,"]')
    columns = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    empty = lambda c: F.coalesce(fields[c] == "", F.lit(True))
    value = (
        empty("source") | empty("file_path") | empty("message")
        | ~(empty("generation") | _counted(fields["generation"]))
        | ~(empty("byte_offset") | _counted(fields["byte_offset"]))
        | ~(empty("line_number") | _counted(fields["line_number"]))
        | ~F.coalesce(fields["error_kind"].isin(ERROR_KINDS), F.lit(False))
        | ~_real_time(fields["first_seen_at"]) | ~_real_time(fields["last_seen_at"])
        | ~_counted(fields["occurrence_count"], 1)
    )
    return (
        F.when(raw.isNull(), "column_count").when(quoting, "quoting").when(columns != len(RECORD_COLUMNS), "column_count").when(value, "value")
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """(record_id, line_number, byte_offset, reason, raw) of the lines that are no single JSON object."""
    return (
        lines.select(F.col("line_id").alias("record_id"), "line_number", "byte_offset", F.col("raw_line").alias("raw"))
        .withColumn("reason", line_reason(F.col("raw")))
        .where("reason is not null")
    )


def read_records(records: DataFrame) -> DataFrame:
    """All records with `fields` and the `reason` for which a record is rejected."""
    return records.withColumn("fields", record_fields(F.col("raw_record"))).withColumn("reason", record_reason(F.col("raw_record"), F.col("fields")))


def valid_records(records: DataFrame) -> DataFrame:
    """The typed IngestErrorSummary rows of the valid records."""
    text = lambda c: F.nullif(F.col(f"fields.{c}"), F.lit("")).alias(c)
    number = lambda c: F.nullif(F.col(f"fields.{c}"), F.lit("")).try_cast("long").alias(c)
    kinds = {"generation": number, "byte_offset": number, "line_number": number, "occurrence_count": number}
    return read_records(records).where("reason is null").select("record_id", "report_file", "record_no", *[kinds.get(c, text)(c) for c in RECORD_COLUMNS])


def rejected(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Every rejected row of both origins: where it stands, why it failed, and its text.

    A record stands at record_no of its report; its byte offset isn't known."""
    of_lines = rejected_lines(lines).select(F.lit("session_lines").alias("origin"), "record_id", "line_number", "byte_offset", "reason", "raw")
    of_records = (
        read_records(records)
        .where("reason is not null")
        .select(F.lit("error_records").alias("origin"), "record_id", F.col("record_no").alias("line_number"), F.lit(None).cast("long").alias("byte_offset"), "reason", F.col("raw_record").alias("raw"))
    )
    return of_lines.unionByName(of_records)
