"""A pass of ingest: list the files, leave out the unchanged, decide for each of the others, and add what is new in one commit.

Sessions are state, events are only ever added. A rewritten file gets a new generation. A pass that finds nothing new writes nothing
but what it learned about the files. Errors are kept apart from events, counted when they are met again, and resolved when their file
reads well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import codec
from loomlog.operators import journal, ordered
from loomlog.plans.store import Store
from loomlog.sources import contents, files, sqlite
from loomlog.tables import ship, stored

INGESTED = "source file ingested successfully"
EMPTY = "empty session file skipped"
KEY = ["source", "source_session_id"]
#: A task reads about so many bytes of files.
TASK_BYTES = 64 << 20


def _now(clock: str | None):
    return F.lit(clock) if clock else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _stores(spark: SparkSession, home: str) -> list[tuple[str, str, str, str]]:
    """(source, path, table of sessions, parent column) of the stores that keep sessions in SQLite: fixed values."""
    return [("opencode", f"{home}/.local/share/opencode/opencode.db", "session", "parent_id"), ("hermes", f"{home}/.hermes/state.db", "sessions", "parent_session_id")]


def changed_files(listed: DataFrame, sessions: DataFrame, errors: DataFrame) -> DataFrame:
    """The listed files that aren't known to be unchanged (side files of settings included), with what is stored for their path. A file with an unresolved broken line is
    read again."""
    known = sessions.where("file_path is not null").select("source", F.col("file_path").alias("path"), F.struct("source_session_id", "file_size", "file_mtime", "content_fingerprint", "next_read_offset", "prefix_fingerprint", F.get_json_object("source_metadata", "$.mtime").cast("long").alias("side_mtime")).alias("known"))
    known = known.groupBy("source", "path").agg(F.max("known").alias("known"))
    broken = errors.where("resolved_at is null and error_kind = 'invalid_json'").select("source", F.col("file_path").alias("path")).distinct().withColumn("retry", F.lit(True))
    rows = listed.join(known, ["source", "path"], "left").join(broken, ["source", "path"], "left").withColumn("retry", F.coalesce("retry", F.lit(False)))
    same = (F.col("known.file_size") == F.col("size")) & (F.col("known.file_mtime") == F.col("mtime")) & F.col("known.content_fingerprint").isNotNull() & F.col("known.side_mtime").eqNullSafe(F.col("side_mtime"))
    return rows.where(F.col("retry") | ~F.coalesce(same, F.lit(False)))


def _spread(rows: DataFrame, size: str) -> DataFrame:
    """The stored rows over as many tasks as their bytes ask for, and there are cores for."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n, max(cores, -(-total // TASK_BYTES)))))


def decided(changed: DataFrame, sessions: DataFrame) -> DataFrame:
    """The changed files with their ids, their facts, and the mode of their import. Of files that claim one session the first by path is
    imported; the others wait for the next pass, when it is known."""
    changed = stored(changed, "changed")
    found = stored(contents.headers(_spread(changed.select("source", "id_kind", "source_session_id", "format", "path", "size"), "size")), "headers")
    rows = changed.join(found, "path").withColumn("empty", (F.col("source") == "codex_cli") & (F.col("size") == 0))
    rows = rows.withColumn("source_session_id", F.coalesce("header_id", F.when(F.col("empty"), F.col("known.source_session_id")), "source_session_id"))
    first = rows.where("error_kind is null").groupBy(*KEY).agg(F.min("path").alias("path"))
    state = sessions.select(*KEY, F.struct("session_id", "current_generation", "file_size", "content_fingerprint", "next_read_offset", "prefix_fingerprint").alias("was"))
    rows = stored(rows.join(first, [*KEY, "path"], "left_semi").unionByName(rows.where("error_kind is not null")).join(state, KEY, "left"), "claimed")
    asked = rows.where("error_kind is null").select("source", "metadata_path", "format", "path", "size", F.col("was.next_read_offset").alias("next_read_offset"), F.col("was.prefix_fingerprint").alias("prefix_fingerprint"))
    facts = stored(contents.facts(_spread(asked, "size")).withColumnsRenamed({"error_kind": "later_error", "message": "later_message"}), "facts")
    rows = rows.join(facts, "path", "left").withColumns({"error_kind": F.coalesce("error_kind", "later_error"), "message": F.coalesce("message", "later_message")}).drop("later_error", "later_message")
    mode = journal.import_mode(
        F.col("size"), F.col("was.file_size"), F.col("was.content_fingerprint") == F.col("fingerprint"), F.col("format") == "jsonl", F.col("prefix_intact"), F.col("retry"), F.coalesce("was.next_read_offset", F.lit(0))
    )
    mode = F.when(F.col("error_kind").isNotNull(), "error").when(F.col("empty") & F.col("was").isNull(), "empty").otherwise(mode)
    generation = F.coalesce("was.current_generation", F.lit(0)) + F.when(mode == "rewrite", 1).otherwise(0)
    start = F.when(mode == "append", F.least(F.coalesce("was.next_read_offset", F.lit(0)), "committed")).otherwise(0)
    return rows.select("*", mode.alias("mode"), generation.alias("generation"), F.when(F.col("format") == "json", 0).otherwise(start).cast("long").alias("start"))


_STORE_EVENTS = "source string, source_session_id string, parent_source_session_id string, path string, seq long, ts string, payload binary"


def store_events(spark: SparkSession, home: str, keep) -> tuple[DataFrame, list[tuple[str, str, str | None]]]:
    """(source, source_session_id, parent_source_session_id, path, seq, ts, payload) of the SQLite stores that can be read, and (source, path,
    what is wrong or None) of all that exist. A broken store keeps no other one from being read."""
    whole, seen = spark.createDataFrame([], _STORE_EVENTS), []
    for (source, path, table, parent), read, tables in zip(_stores(spark, home), (sqlite.opencode_events, sqlite.hermes_events), (sqlite.OPENCODE, sqlite.HERMES)):
        if not files.exists(spark, path):
            continue
        wrong = sqlite.problem(path, source, tables, table)
        if wrong is None:
            try:
                events = ordered.numbered(keep(read(spark, path), "store"), ["source_session_id"], [F.col("sort_time"), F.col("rank"), F.col("id")], "seq", keep)
                sessions = keep(sqlite.discover(spark, path, source, table, parent).select("source_session_id", "parent_source_session_id"), "store_sessions")
                whole = whole.unionByName(events.join(sessions, "source_session_id").select(F.lit(source).alias("source"), "source_session_id", "parent_source_session_id", F.lit(path).alias("path"), "seq", "ts", "payload"))
            except Exception as error:  # a store that breaks in the middle
                wrong = f"{sqlite.STORE_NAMES.get(source, source)}: {str(error).strip().splitlines()[0] if str(error).strip() else type(error).__name__}"
        seen.append((source, path, wrong))
    return whole, seen


def _store_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The stores' sessions whose events aren't those stored, as imports with their generation. What tells them apart is made of sums over the
    hashes of single events, so that a session of any size needs no list."""
    one, other = F.xxhash64("seq", "payload"), F.xxhash64(F.lit("other"), "payload", "seq")
    mark = F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(one), F.sum(one.cast("decimal(38,0)")), F.bit_xor(other), F.sum(other.cast("decimal(38,0)")))
    seen = events.groupBy(*KEY).agg(
        F.first("parent_source_session_id").alias("parent_source_session_id"), F.first("path").alias("path"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("event_count"), mark.alias("fingerprint")
    )
    was = sessions.select(*KEY, F.struct("current_generation", "content_fingerprint", "event_count").alias("was"))
    rows = seen.join(was, KEY, "left").where(~F.coalesce(F.col("was.content_fingerprint") == F.col("fingerprint"), F.lit(False)))
    fresh = F.col("was").isNull() | (F.col("was.event_count") == 0)
    return rows.withColumn("generation", F.when(fresh, F.coalesce("was.current_generation", F.lit(0))).otherwise(F.col("was.current_generation") + 1)).drop("was")


def run(spark: SparkSession, home: str, store: Store, clock: str | None = None) -> dict[str, int]:
    """One pass over a home. Returns the files seen, the events added, the files that added nothing, and the files with errors."""
    ship(spark)
    with store.writing():
        return _pass(spark, home, store, _now(clock))


def _pass(spark: SparkSession, home: str, store: Store, now) -> dict[str, int]:
    sessions, errors = store.table("sessions"), store.table("ingest_errors")
    listed = stored(files.discover(spark, home), "listed")
    plan = stored(decided(changed_files(listed, sessions, errors), sessions), "plan")
    read = plan.where("mode in ('append', 'rewrite')")
    parts = stored(contents.ranges(read), "ranges")
    lines = stored(contents.events(_spread(parts.withColumn("bytes", F.col("high") - F.col("base")), "bytes")), "lines")
    if lines.where("error_kind is not null").limit(1).count():
        lines = stored(contents.up_to_the_first_bad(lines), "lines")
    good = lines.where("error_kind is null").join(read.select("path", *KEY, "generation"), "path")
    from_stores, stores = store_events(spark, home, stored)
    store_seen = stored(_store_sessions(from_stores, sessions), "stores")
    store_new = from_stores.join(store_seen.select(*KEY, "generation"), KEY)

    of_files = (
        read.join(
            lines.groupBy("path").agg(
                F.max(F.when(F.col("error_kind").isNull(), F.col("end_offset"))).alias("last_end"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("seq"))).alias("first_cwd"),
            ),
            "path",
            "left",
        )
        .withColumn("next_read_offset", F.when(F.col("format") == "json", F.col("committed")).otherwise(F.coalesce("last_end", "start")))
        .select(
            *KEY, "parent_source_session_id", F.col("path").alias("file_path"), F.coalesce("first_cwd", "meta_cwd").alias("cwd"), F.coalesce("first_ts", "meta_started").alias("started_at"), F.coalesce("last_ts", "meta_ended").alias("ended_at"),
            "generation", F.col("mtime").alias("file_mtime"), F.col("size").alias("file_size"), F.col("fingerprint").alias("content_fingerprint"), "next_read_offset", F.col("metadata").alias("source_metadata"),
            F.when(F.col("next_read_offset") == F.col("committed"), F.col("committed_fingerprint")).alias("known_prefix"),
        )
    )
    of_files = stored(of_files, "of_files")
    marks = contents.prefixes(of_files.where("known_prefix is null").select("file_path", "file_size", "next_read_offset"))  # files that a bad line has stopped
    of_files = of_files.join(marks, "file_path", "left").withColumn("prefix_fingerprint", F.coalesce("known_prefix", "prefix_fingerprint")).drop("known_prefix")
    of_stores = store_seen.select(
        *KEY, "parent_source_session_id", F.col("path").alias("file_path"), F.lit(None).cast("string").alias("cwd"), "started_at", "ended_at", "generation", F.lit(None).cast("long").alias("file_mtime"),
        F.lit(None).cast("long").alias("file_size"), F.col("fingerprint").alias("content_fingerprint"), F.col("event_count").alias("next_read_offset"), F.lit(None).cast("string").alias("source_metadata"), F.lit(None).cast("string").alias("prefix_fingerprint"),
    )
    broken = spark.createDataFrame([(s, sqlite.placeholder(p), p) for s, p, wrong in stores if wrong], "source string, source_session_id string, file_path string").join(sessions, KEY, "left_anti")
    of_broken = broken.withColumns({"generation": F.lit(0).cast("long"), "next_read_offset": F.lit(0).cast("long")})
    imported = stored(of_files.unionByName(of_stores).unionByName(of_broken, allowMissingColumns=True), "imported")
    skipped = plan.where("mode = 'skip'").select(*KEY, F.col("size").alias("skip_size"), F.col("mtime").alias("skip_mtime"), F.col("path").alias("skip_path"), F.col("metadata").alias("skip_metadata")).dropDuplicates(KEY)

    known = sessions.select(*KEY, "session_id")
    fresh = imported.join(known, KEY, "left_anti").select(*KEY)
    base = sessions.agg(F.coalesce(F.max("session_id"), F.lit(0)).alias("base")).first()["base"]
    ids = known.unionByName(ordered.numbered(fresh, [], [F.col("source"), F.col("source_session_id")], "n", stored).select(*KEY, (F.col("n") + base + 1).alias("session_id")))
    ids = stored(ids, "ids")
    seen = good.select(*KEY, "generation", "seq", "ts", "payload").unionByName(store_new.select(*KEY, "generation", "seq", "ts", "payload"))
    encoded = seen.join(ids, KEY).select("session_id", "generation", "seq", "ts", codec.encode("payload").alias("e")).select("session_id", "generation", "seq", "ts", "e.*", now.alias("created_at"))
    touched = ids.join(imported.select(*KEY), KEY, "left_semi").select("session_id")
    had = store.table("events").join(touched, "session_id", "left_semi").select("session_id", "generation", "seq")
    new = stored(journal.new_events(encoded, had, ["session_id", "generation", "seq"]), "new_events")

    counts = had.unionByName(new.select("session_id", "generation", "seq")).groupBy("session_id", "generation").agg(F.count(F.lit(1)).alias("n"))
    merged = _merge(sessions, imported, skipped, ids, counts, now)
    failed = _errors(plan, lines, read, stores, now)
    fixed = _fixed(plan, lines, stores)
    after = journal.resolve_errors(_upserted(errors, failed), fixed, now, INGESTED)
    rows = store.commit(sessions=merged, events=new, ingest_errors=after)
    seen_files, bad = listed.count(), plan.where("error_kind is not null").count() + sum(wrong is not None for _, _, wrong in stores)
    added = good.join(new.join(ids, "session_id").select(*KEY).distinct(), KEY, "left_semi").select("path").distinct().count()
    return {"files": seen_files, "inserted_events": rows["events"], "skipped_files": max(0, seen_files - added - bad), "error_files": bad}


def _merge(sessions: DataFrame, imported: DataFrame, skipped: DataFrame, ids: DataFrame, counts: DataFrame, now) -> DataFrame:
    old, new = sessions.drop("session_id", "parent_session_id").alias("o"), imported.alias("n")
    pick = lambda c, mine=None: F.coalesce(f"n.{mine or c}", f"o.{c}").alias(c)
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY]
    both = old.join(new, on, "full").select(
        *[pick(k) for k in KEY], pick("file_path"), pick("cwd"), pick("parent_source_session_id"), F.least("o.started_at", "n.started_at").alias("started_at"), F.greatest("o.ended_at", "n.ended_at").alias("ended_at"),
        pick("current_generation", "generation"), pick("file_mtime"), pick("file_size"), pick("content_fingerprint"), pick("prefix_fingerprint"), pick("next_read_offset"), F.col("o.event_count").alias("old_count"),
        pick("source_metadata"), F.coalesce("o.created_at", now).alias("created_at"), F.when(F.col("n.source").isNotNull(), now).otherwise(F.col("o.updated_at")).alias("updated_at"), F.col("n.source").isNotNull().alias("touched"),
    )
    both = both.join(ids, KEY).join(counts.withColumnRenamed("generation", "current_generation"), ["session_id", "current_generation"], "left").join(skipped, KEY, "left")
    parents = ids.select("source", F.col("source_session_id").alias("parent_source_session_id"), F.col("session_id").alias("parent_session_id"))
    return (
        both.withColumn("event_count", F.when(F.col("touched"), F.coalesce("n", F.lit(0))).otherwise(F.col("old_count")))
        .withColumns({"file_size": F.coalesce("skip_size", "file_size"), "file_mtime": F.coalesce("skip_mtime", "file_mtime"), "file_path": F.coalesce("skip_path", "file_path"), "source_metadata": F.coalesce("skip_metadata", "source_metadata")})
        .join(parents, ["source", "parent_source_session_id"], "left")
    )


def _errors(plan: DataFrame, lines: DataFrame, read: DataFrame, stores: list, now) -> DataFrame:
    """The errors of this pass: files and stores that can't be read, and the line at which a file stops."""
    none = F.lit(None).cast("long")
    whole = plan.where("error_kind is not null").select("source", F.lit(None).cast("string").alias("source_session_id"), F.col("path").alias("file_path"), none.alias("generation"), none.alias("byte_offset"), none.alias("line_number"), "error_kind", "message")
    bad = lines.where("error_kind is not null").join(read.select("path", *KEY, "generation"), "path")
    stops = bad.select(*KEY, F.col("path").alias("file_path"), "generation", "byte_offset", (F.col("seq") + 1).alias("line_number"), "error_kind", "message")
    broken = [(source, sqlite.placeholder(path), path, None, None, None, "invalid_session_meta", wrong) for source, path, wrong in stores if wrong]
    whole = whole.unionByName(whole.sparkSession.createDataFrame(broken, whole.schema))
    return whole.unionByName(stops).select("*", now.alias("first_seen_at"), now.alias("last_seen_at"), F.lit(1).cast("long").alias("occurrence_count"))


def _upserted(errors: DataFrame, failed: DataFrame) -> DataFrame:
    """Unresolved errors with those of this pass folded in; resolved ones stay as they are."""
    open_ones = errors.where("resolved_at is null")
    folded = journal.upsert_errors(open_ones.drop("resolved_at", "resolution_note"), failed)
    return folded.withColumns({"resolved_at": F.lit(None).cast("string"), "resolution_note": F.lit(None).cast("string")}).unionByName(errors.where("resolved_at is not null"))


def _fixed(plan: DataFrame, lines: DataFrame, stores: list) -> DataFrame:
    """(source, file_path, error_kind) that this pass has shown to be well."""
    well = plan.where("error_kind is null").select("source", F.col("path").alias("file_path"), F.explode(F.array(*[F.lit(k) for k in ("invalid_session_meta", "read_error", "not_file")])).alias("error_kind"))
    broken = lines.where("error_kind = 'invalid_json'").select("path")
    read = plan.where("error_kind is null and mode in ('append', 'rewrite')").join(broken, "path", "left_anti")
    mended = well.sparkSession.createDataFrame([(source, path, "invalid_session_meta") for source, path, wrong in stores if not wrong], "source string, file_path string, error_kind string")
    return well.unionByName(mended).unionByName(read.select("source", F.col("path").alias("file_path"), F.lit("invalid_json").alias("error_kind")))


def parent_sessions(sessions: DataFrame, source: str, session: str | None = None) -> DataFrame:
    """The sessions of a tool that have no parent, by id, or the one asked for; LookupError where there is none."""
    found = sessions.where((F.col("source") == source) & F.col("parent_session_id").isNull())
    if session is not None:
        found = found.where(F.col("source_session_id") == session)
        if not found.limit(1).count():
            raise LookupError(f"no session {session} of {source}")
    return found.orderBy("session_id")


def extract(spark: SparkSession, store: Store, history_root: str, force: bool = False, clock: str | None = None, session: tuple[str, str] | None = None) -> dict[str, int]:
    """Compiles the examples of all sessions that need it, or of the one asked for (source, source_session_id), subagents with their parents,
    and replaces what those sessions had."""
    from loomlog.operators import taste

    ship(spark)
    now = _now(clock)
    with store.writing():
        sessions = store.table("sessions")
        family = sessions.select("session_id", "source", F.coalesce("parent_source_session_id", "source_session_id").alias("source_session_id"), F.col("source_session_id").alias("own"), "current_generation", "event_count", "cwd", "parent_source_session_id")
        counts = family.groupBy(*KEY).agg(F.sum("event_count").alias("event_count"), F.max(F.when(F.col("parent_source_session_id").isNull(), F.col("cwd"))).alias("cwd"))
        if session is not None:
            counts = counts.join(parent_sessions(sessions, *session).select(*KEY), KEY, "left_semi")
        todo = stored(taste.pending(counts, store.table("taste_extractions"), force=force), "pending")
        streams = family.join(todo.select(*KEY), KEY, "left_semi")
        chain = F.when(F.col("parent_source_session_id").isNotNull(), F.substring_index("own", "/subagents/", -1))
        numbered = ordered.numbered(streams, KEY, [F.col("parent_source_session_id").asc_nulls_first(), F.col("session_id")], "stream_idx", stored)
        rows = store.table("events").join(numbered.select("session_id", F.col("current_generation").alias("generation"), *KEY, F.col("stream_idx").cast("int").alias("stream_idx"), chain.alias("agent_id")), ["session_id", "generation"])
        lines = rows.select(*KEY, "stream_idx", "agent_id", F.col("seq").alias("line_seq"), codec.decode("payload", "codec").cast("string").alias("payload"))
        timeline, examples = taste.extract(lines, todo, contents.blobs(spark, history_root), stored)
        done = todo.select(*KEY, F.lit(taste.VERSION).alias("extractor_version"), "event_count", now.alias("extracted_at"))
        timeline, examples = stored(timeline, "timeline"), stored(examples, "examples")
        store.replace_sessions(todo, file_timelines=timeline, preference_examples=examples, taste_extractions=done)
        return {"sessions": todo.count(), "timeline_rows": timeline.count(), "examples": examples.count()}


def compact(store: Store, apply: bool = False) -> dict[str, int]:
    """What compaction does with the raw payloads, done where asked for: those that get smaller and come back the same are packed. Only the
    folders that hold such rows are written anew, under the lock from the first read on."""
    if not apply:
        return _compacted(store, False)
    with store.writing():
        return _compacted(store, True)


def _compacted(store: Store, apply: bool) -> dict[str, int]:
    held = store.state()["tables"].get("events", [])
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/[^/]*$", 1) if held else F.lit("")
    events = store.table("events").select("*", folder.alias("folder"))
    packed = F.col("p.action") == "compact"
    planned = stored(events.where("codec = 'raw'").select("session_id", "generation", "seq", "ts", "payload", "payload_size", "created_at", "folder", codec.plan("payload").alias("p")), "plan")
    found = {r["action"]: r for r in planned.groupBy(F.col("p.action").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.saved").alias("saved")).collect()}
    report = {a: found[a]["n"] if a in found else 0 for a in ("compact", "small", "not_smaller", "round_trip_failed")} | {"saved_bytes": found["compact"]["saved"] if "compact" in found else 0}
    if apply and report["compact"]:
        touched = sorted({r["folder"] for r in planned.where(packed).select("folder").distinct().collect()} & set(held))  # names of folders, one for each pass
        raw = planned.where(F.col("folder").isin(touched)).select(
            "session_id", "generation", "seq", "ts", F.when(packed, F.col("p.packed")).otherwise(F.col("payload")).alias("payload"), F.when(packed, "zstd").otherwise("raw").alias("codec"), "payload_size", "created_at"
        )
        rest = events.where(F.col("folder").isin(touched) & (F.col("codec") != "raw")).drop("folder")
        store.replace_folders("events", touched, rest.unionByName(raw))
    return report
