"""Queries on the journal: counts, bounds, pages, searches, lookups and state changes, each on the DataFrames it needs.

Null handling is stated with each; empty inputs give empty results, or one row of zeros for counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import text

#: Sizes of pages, the largest offset, the shortest search of payloads, sizes of batches: fixed values.
SESSION_PAGE, EVENT_PAGE, ERROR_PAGE = 50, 25, 50
MAX_OFFSET, MIN_SEARCH, BATCH, MAX_BATCH = 100_000, 3, 1_000, 10_000
NATURAL = ["source", "source_session_id"]


def status(sessions: DataFrame, events: DataFrame, errors: DataFrame) -> DataFrame:
    """One row with three counts. Each table is counted by itself; the three counts are put side by side without a join."""
    tables = {"sessions": sessions, "events": events, "errors": errors}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    whole = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return whole.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables])


def unresolved(errors: DataFrame) -> DataFrame:
    return errors.where(F.col("resolved_at").isNull())


def recent_errors(errors: DataFrame, limit: int = ERROR_PAGE) -> DataFrame:
    """The newest errors; ties by id, newest first."""
    return errors.orderBy(F.desc("last_seen_at"), F.desc("id")).limit(limit)


def doctor(errors: DataFrame, details: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """(unresolved) and, where asked for, the newest errors."""
    return errors.agg(F.count(F.lit(1)).alias("unresolved")), recent_errors(errors, details) if details else None


def checked_limit(limit: int) -> int:
    if limit < 1:
        raise ValueError("a limit must be at least 1")
    return limit


def checked_offset(offset: int) -> int:
    """Offsets beyond MAX_OFFSET begin anew."""
    return offset if 0 <= offset <= MAX_OFFSET else 0


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """A page and one row more, by which the caller sees whether there is a next one."""
    return rows.orderBy(*order).offset(checked_offset(offset)).limit(checked_limit(size) + 1)


def sessions_page(sessions: DataFrame, search: str | None = None, hits: DataFrame | None = None, size: int = SESSION_PAGE, offset: int = 0) -> DataFrame:
    """The newest sessions with their parent's id in its tool, by started_at (updated_at where null), then id; searched literally in four
    columns, or found by payload (hits: session_id)."""
    parents = sessions.select(F.col("session_id").alias("parent_session_id"), F.col("source_session_id").alias("parent_source_session_id"))
    rows = sessions.drop("parent_source_session_id").join(parents, "parent_session_id", "left")
    if search:
        found = text.literal_contains(F.col("source"), search)
        for c in ("source_session_id", "cwd", "file_path"):
            found = found | text.literal_contains(F.col(c), search)
        if hits is not None:
            rows = rows.join(hits.select("session_id").distinct().withColumn("hit", F.lit(True)), "session_id", "left")
            found = found | F.coalesce("hit", F.lit(False))
        rows = rows.where(found)
    order = [F.coalesce("started_at", "updated_at").desc(), F.desc("session_id")]
    return page(rows.select("session_id", *NATURAL, "parent_source_session_id", "started_at", "updated_at", "event_count"), order, size, offset)


def events_page(events: DataFrame, size: int = EVENT_PAGE, offset: int = 0) -> DataFrame:
    """A page of events without their payloads."""
    return page(events.drop("payload"), [F.col("generation"), F.col("seq")], size, offset)


def selected(page_rows: DataFrame, sessions: DataFrame, session_id: int | None):
    """The requested session if it is on the page or exists at all, else the page's first row; None on an empty page."""
    if session_id is not None:
        found = page_rows.where(F.col("session_id") == session_id).limit(1).collect() or sessions.where(F.col("session_id") == session_id).limit(1).collect()
        if found:
            return found[0]
    return page_rows.first()


def payload_hits(heads: DataFrame, needle: str) -> DataFrame:
    """The sessions of which a payload's head (session_id, head binary) holds the needle, in any case; short needles hit nothing."""
    if len(needle) < MIN_SEARCH:
        return heads.select("session_id").where("false")
    return heads.where(text.literal_contains(F.make_valid_utf8(F.col("head").cast("string")), needle)).select("session_id").distinct()


def optional_equal(rows: DataFrame, **wanted) -> DataFrame:
    """Equality on the given columns that aren't None."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def session_events(events: DataFrame, sessions: DataFrame, source: str, session: str, limit: int | None = None) -> DataFrame:
    """The events of one session in the order of their generations."""
    chosen = sessions.where((F.col("source") == source) & (F.col("source_session_id") == session)).select("session_id")
    rows = events.join(chosen, "session_id", "left_semi").orderBy("generation", "seq")
    return rows if limit is None else rows.limit(checked_limit(limit))


def guarded(rows: DataFrame, codec: str = "codec") -> DataFrame:
    """The same rows, failing on an unsupported codec among those that are really returned."""
    fine = F.col(codec).isin("raw", "zstd")
    return rows.withColumn(codec, F.when(fine, F.col(codec)).otherwise(F.raise_error(F.concat(F.lit("unsupported codec "), F.coalesce(codec, F.lit("null"))))))


def after(rows: DataFrame, keys: list[str], cursor: tuple, size: int = BATCH) -> DataFrame:
    """The next batch in the order of keys after a cursor. The first key alone is compared, too, as only that reaches the scan."""
    if not 1 <= size <= MAX_BATCH:
        raise ValueError(f"a batch has 1 to {MAX_BATCH} rows")
    return rows.where(F.col(keys[0]) >= F.lit(cursor[0])).where(F.struct(*keys) > F.struct(*[F.lit(x).alias(k) for k, x in zip(keys, cursor)])).orderBy(*keys).limit(size)


def nth(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n-th row of an order, if there is one."""
    return rows.orderBy(*order).offset(checked_limit(n) - 1).limit(1)


def bounds(events: DataFrame, key: list[str], ts: str) -> DataFrame:
    """First and last time as text, and the number of rows, for each key."""
    return events.groupBy(*key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def first_known(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """The first non-null value of each key."""
    return rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(f"first_{value}"))


def family_event_count(sessions: DataFrame) -> DataFrame:
    """(session_id, event_count) of each session without parent, its children's events included."""
    children = sessions.where("parent_session_id is not null").groupBy("parent_session_id").agg(F.sum("event_count").alias("theirs"))
    parents = sessions.where("parent_session_id is null").select("session_id", "event_count")
    own = parents.join(children, parents["session_id"] == children["parent_session_id"], "left")
    return own.select("session_id", (F.coalesce("event_count", F.lit(0)) + F.coalesce("theirs", F.lit(0))).alias("event_count"))


def lookup_files(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each file with the session stored under its id and the one stored under its path, which may be another one."""
    by_id = sessions.select(*NATURAL, F.col("session_id").alias("id_session"))
    by_path = sessions.where("file_path is not null").select("source", F.col("file_path").alias("path"), F.col("session_id").alias("path_session")).groupBy("source", "path").agg(F.min("path_session").alias("path_session"))
    return files.join(by_id, NATURAL, "left").join(by_path, ["source", "path"], "left")


def codec_stats(events: DataFrame) -> DataFrame:
    """One pass: rows by codec, small raw ones, and stored bytes."""
    size = F.octet_length("payload")
    return events.agg(
        F.count_if(F.col("codec") == "raw").alias("raw_events"),
        F.count_if(F.col("codec") == "zstd").alias("zstd_events"),
        F.count_if(~F.col("codec").isin("raw", "zstd")).alias("unsupported_events"),
        F.count_if((F.col("codec") == "raw") & (size < 1024)).alias("small_events"),
        F.coalesce(F.sum(size), F.lit(0)).alias("stored_bytes"),
    )


def import_mode(size: Column, stored_size: Column, same_content: Column, jsonl: Column, prefix_intact: Column, retry: Column, offset: Column) -> Column:
    """skip, append or rewrite, the first that holds: same size and content; never sized; a changed prefix of a line file; a line file
    that grew, or that is to be read again from its offset; all else."""
    return (
        F.when(F.coalesce((size == stored_size) & same_content, F.lit(False)), "skip")
        .when(stored_size.isNull(), "append")
        .when(jsonl & ~prefix_intact, "rewrite")
        .when(jsonl & ((retry & (size >= offset)) | (size > stored_size)), "append")
        .otherwise("rewrite")
    )


ERROR_KEY = ["source", "source_session_id", "file_path", "generation", "byte_offset", "line_number", "error_kind"]


def upsert_errors(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """The errors after a pass: seen again ones counted up with the newest message and time, new ones added. Null keys are equal to null.

    Both: ERROR_KEY, message, first_seen_at, last_seen_at, occurrence_count. One aggregation, so that an error kept in many rows of
    either side needs no join."""
    rows = stored.withColumn("_pass", F.lit(0)).unionByName(seen.withColumn("_pass", F.lit(1)))
    newest = F.struct("_pass", "last_seen_at", "message")
    return rows.groupBy(*ERROR_KEY).agg(
        F.max_by("message", newest).alias("message"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("occurrence_count").alias("occurrence_count")
    )


def resolve_errors(errors: DataFrame, fixed: DataFrame, at: Column, note: str) -> DataFrame:
    """Unresolved errors of fixed (source, file_path, error_kind) get a time and a note."""
    keys = fixed.select("source", "file_path", "error_kind").distinct().withColumn("_fixed", F.lit(True))
    rows = errors.join(keys, ["source", "file_path", "error_kind"], "left")
    now = F.col("_fixed").isNotNull() & F.col("resolved_at").isNull()
    return rows.withColumn("resolution_note", F.when(now, F.lit(note)).otherwise(F.col("resolution_note"))).withColumn("resolved_at", F.when(now, at).otherwise(F.col("resolved_at"))).drop("_fixed").select(errors.columns)


def merge_sessions(stored: DataFrame, imported: DataFrame) -> DataFrame:
    """Sessions after an import: a new cwd wins, times widen, progress is overwritten; sessions on one side only are kept as they are.

    Both: source, source_session_id, cwd, started_at, ended_at, generation, event_count, next_read_offset."""
    old, new = stored.alias("o"), imported.alias("n")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return old.join(new, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in NATURAL], "full").select(
        *[pick(k) for k in NATURAL], pick("cwd"),
        F.least("o.started_at", "n.started_at").alias("started_at"), F.greatest("o.ended_at", "n.ended_at").alias("ended_at"),
        pick("generation"), pick("event_count"), pick("next_read_offset"),
    )


def sidechain_ids(sessions: DataFrame) -> DataFrame:
    """(session_id, source_session_id) of the claude_cli sessions `agent-...` that a stored parent, or without one their path, qualifies as
    <parent>/subagents/<own>: an update from a join, and where that has none from the path."""
    parents = sessions.select(F.col("session_id").alias("parent_session_id"), F.col("source_session_id").alias("parent_id"))
    agents = sessions.where("source = 'claude_cli' and source_session_id like 'agent-%'").select("session_id", "source_session_id", "parent_session_id", "file_path")
    rows = agents.join(parents, "parent_session_id", "left")
    end = F.concat(F.lit("/subagents/"), "source_session_id", F.lit(".jsonl"))
    owner = F.right(F.substring(F.col("file_path"), F.lit(1), F.length("file_path") - F.length(end)), F.lit(36))
    shaped = F.col("parent_session_id").isNull() & F.endswith(F.col("file_path"), end) & owner.rlike(r"(?s)\A.{8}-.{4}-.{4}-.{4}-.{12}\z")
    parent = F.coalesce("parent_id", F.when(shaped, owner))
    return rows.where(parent.isNotNull()).select("session_id", F.concat(parent, F.lit("/subagents/"), "source_session_id").alias("source_session_id"))


def new_events(seen: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Events whose key isn't stored; of repeated ones, one."""
    return seen.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def beyond_newest(rows: DataFrame, name: str, keep: int) -> DataFrame:
    """What a retention of the newest names deletes: those before the least of the newest `keep`, which is read to the driver. Rows of one name
    stay or go together; a null name goes."""
    newest = rows.where(F.col(name).isNotNull()).select(name).orderBy(F.desc(name)).limit(keep)
    bound = newest.agg(F.min(name), F.count(F.lit(1))).first()
    gone = F.col(name).isNull()
    return rows.where(gone if bound[1] < keep else gone | (F.col(name) < F.lit(bound[0]))) if keep else rows
