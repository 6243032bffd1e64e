"""Tables of SQLite files as a Spark data source, opened read only, and the events of two stores that keep their sessions so.

spark.read.format("sqlite_table").option("path", file).option("table", name).option("columns", "a long, b string")
Partitions are ranges of rowid. A missing file has no rows; an unreadable one, or a row that doesn't fit the columns, is an error.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROWS_PER_PARTITION = 200_000


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class TableReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.table = schema.fieldNames(), options["path"], options["table"]

    def partitions(self) -> list[RowRange]:
        if not os.path.exists(self.path):
            return []
        parts, low = [], None
        with connect(self.path) as c:  # from one rowid that exists to the next, as there may be wide gaps
            found = c.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
            low, high = found
            while low is not None and low <= high:
                after = c.execute(f'select rowid from "{self.table}" where rowid >= ? order by rowid limit 1 offset ?', (low, ROWS_PER_PARTITION)).fetchone()
                parts.append(RowRange(low, after[0] if after else high + 1))
                low = after[0] if after else None
        return parts

    def read(self, partition: RowRange | None) -> Iterator[tuple]:
        if partition is None:  # where there are no ranges
            return
        with connect(self.path) as c:
            columns = ", ".join(f'"{n}"' for n in self.names)
            yield from c.execute(f'select {columns} from "{self.table}" where rowid >= ? and rowid < ?', (partition.low, partition.high))


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(schema, dict(self.options))


def read_table(spark: SparkSession, path: str, table: str, columns: str) -> DataFrame:
    from loomlog.tables import ship

    ship(spark)
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("columns", columns).load()


#: The stores and what they are called in errors: fixed values.
STORE_NAMES = {"opencode": "OpenCode SQLite store", "hermes": "Hermes SQLite SessionDB"}


def placeholder(path: str) -> str:
    """The id that stands for a whole store."""
    return os.path.basename(path)


def problem(path: str, source: str, tables: dict[str, str], sessions: str) -> str | None:
    """What is wrong with a store as a whole: it can't be opened, lacks a table or column, or has a session with a blank id."""
    try:
        with connect(path) as c:
            for table, columns in tables.items():
                names = ", ".join(f'"{x.split()[0]}"' for x in columns.split(","))
                have = {r[1] for r in c.execute(f'pragma table_info("{table}")')}
                if missing := [x.strip() for x in names.split(",") if x.strip().strip('"') not in have]:
                    return f"{STORE_NAMES.get(source, source)}: {table} has no {', '.join(missing)}"
            if c.execute(f'select count(*) from "{sessions}" where id is null or trim(id) = \'\'').fetchone()[0]:
                return f"{STORE_NAMES.get(source, source)}: a session has no id"
    except sqlite3.Error as error:
        return f"{STORE_NAMES.get(source, source)}: {error}"
    return None


def discover(spark: SparkSession, path: str, source: str, table: str, parent: str) -> DataFrame:
    """The sessions of a store as source files. A missing file lists nothing; an unreadable one, or one with a blank id, gives a single row that
    stands for the whole store."""
    columns = "source string, source_session_id string, id_kind string, parent_source_session_id string, metadata_path string, format string, path string"
    whole = spark.createDataFrame([(source, placeholder(path), "store_error", None, None, "sqlite", path)], columns)
    if not os.path.exists(path):
        return whole.where("false")
    if problem(path, source, {}, table):
        return whole
    rows = read_table(spark, path, table, f"id string, {parent} string")
    none = F.lit(None).cast("string")
    return rows.select(F.lit(source).alias("source"), F.col("id").alias("source_session_id"), F.lit("known").alias("id_kind"), F.col(parent).alias("parent_source_session_id"), none.alias("metadata_path"), F.lit("sqlite").alias("format"), F.lit(path).alias("path"))


def as_json(column: str | Column) -> Column:
    """The value that a text holds as JSON, or the text itself."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.try_parse_json(column), column.cast("variant"))


def _iso_ms(column: str) -> Column:
    return F.date_format(F.timestamp_millis(F.col(column)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _iso_s(column: str) -> Column:
    """Seconds with a fraction, rounded to milliseconds."""
    return F.date_format(F.timestamp_millis(F.round(F.col(column) * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _object(**fields) -> Column:
    """A JSON object with its names sorted and nulls kept."""
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in sorted(fields.items())])


def _fields(df: DataFrame, prefix: str = "") -> dict:
    return {c: as_json(prefix + c) if c in JSON_COLUMNS else prefix + c for c in df.columns}


def _payload(**fields) -> Column:
    return F.to_json(_object(**fields), {"ignoreNullFields": "false"}).cast("binary")


#: The columns that are read: fixed values.
OPENCODE = {
    "project": "id string, worktree string, vcs string, name string, icon_url string, icon_color string, time_created long, time_updated long, time_initialized long, sandboxes string, commands string",
    "session": "id string, project_id string, parent_id string, slug string, directory string, title string, version string, share_url string, summary_additions long, summary_deletions long, summary_files long,"
    " summary_diffs string, revert string, permission string, time_created long, time_updated long, time_compacting long, time_archived long, workspace_id string",
    "message": "id string, session_id string, time_created long, time_updated long, data string",
    "part": "id string, message_id string, session_id string, time_created long, time_updated long, data string",
    "session_message": "id string, session_id string, type string, time_created long, time_updated long, data string",
}
HERMES = {
    "sessions": "id string, source string, user_id string, model string, model_config string, system_prompt string, parent_session_id string, started_at double, ended_at double, end_reason string, message_count long,"
    " tool_call_count long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, billing_provider string, billing_base_url string, billing_mode string,"
    " estimated_cost_usd double, actual_cost_usd double, cost_status string, cost_source string, pricing_version string, title string, api_call_count long",
    "messages": "id long, session_id string, role string, content string, tool_call_id string, tool_calls string, tool_name string, timestamp double, token_count long, finish_reason string, reasoning string,"
    " reasoning_details string, codex_reasoning_items string, reasoning_content string, codex_message_items string",
}
#: Columns that hold JSON as text: fixed values.
JSON_COLUMNS = {"sandboxes", "commands", "summary_diffs", "revert", "permission", "model_config", "tool_calls", "reasoning_details", "codex_reasoning_items", "codex_message_items"}
EVENTS = ["source_session_id", "sort_time", "rank", "id", "ts", "payload"]


def opencode_events(spark: SparkSession, path: str) -> DataFrame:
    """EVENTS of a store: a session with its project, then its messages, parts and further messages, by time."""
    t = {name: read_table(spark, path, name, columns) for name, columns in OPENCODE.items()}
    p = t["project"].select(*[F.col(c).alias(f"p_{c}") for c in t["project"].columns])
    s = t["session"].join(p, F.col("project_id") == F.col("p_id"), "left")
    row = _object(**_fields(t["session"]), time_created_iso=_iso_ms("time_created"), time_updated_iso=_iso_ms("time_updated"))
    project = _object(
        **_fields(t["project"], "p_"),
        time_created_iso=_iso_ms("p_time_created"), time_updated_iso=_iso_ms("p_time_updated"), time_initialized_iso=_iso_ms("p_time_initialized"),
    )
    payload = _payload(type=F.lit("session"), table=F.lit("session"), row=row, project=project)
    events = s.select(F.col("id").alias("source_session_id"), F.col("time_created").alias("sort_time"), F.lit(0).alias("rank"), "id", _iso_ms("time_created").alias("ts"), payload.alias("payload"))
    none = F.lit(None).cast("string")
    for rank, name in enumerate(("message", "part", "session_message"), 1):
        message_id = F.col("message_id") if name == "part" else none
        kind = F.col("type") if name == "session_message" else none
        row = _object(
            id="id", session_id="session_id", message_id=message_id, source_type=kind, time_created="time_created", time_updated="time_updated",
            time_created_iso=_iso_ms("time_created"), time_updated_iso=_iso_ms("time_updated"), data=as_json("data"),
        )
        payload = _payload(type=F.lit(name), table=F.lit(name), row=row)
        events = events.unionByName(t[name].select(F.col("session_id").alias("source_session_id"), F.col("time_created").alias("sort_time"), F.lit(rank).alias("rank"), "id", _iso_ms("time_created").alias("ts"), payload.alias("payload")))
    return events


def hermes_events(spark: SparkSession, path: str) -> DataFrame:
    """EVENTS of a store: a session, then its messages by time; the store's search tables are left out."""
    s, m = (read_table(spark, path, name, columns) for name, columns in HERMES.items())
    row = _object(**_fields(s), started_at_iso=_iso_s("started_at"), ended_at_iso=_iso_s("ended_at"))
    micros = lambda c: (F.col(c) * 1_000_000).cast("long")
    first = s.select(F.col("id").alias("source_session_id"), micros("started_at").alias("sort_time"), F.lit(0).alias("rank"), "id", _iso_s("started_at").alias("ts"), _payload(type=F.lit("session"), table=F.lit("sessions"), row=row).alias("payload"))
    row = _object(**_fields(m), timestamp_iso=_iso_s("timestamp"))
    rest = m.select(F.col("session_id").alias("source_session_id"), micros("timestamp").alias("sort_time"), F.lit(1).alias("rank"), F.lpad(F.col("id").cast("string"), 20, "0").alias("id"), _iso_s("timestamp").alias("ts"), _payload(type=F.lit("message"), table=F.lit("messages"), row=row).alias("payload"))
    return first.unionByName(rest)
