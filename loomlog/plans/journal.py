"""The journal's queries over the given tables, each with its SQL. Sessions, timelines and examples are the tables of these names; events
are session_lines of a file and generation; the messages of a session are a stream of events, too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.functions import codec, text
from loomlog.operators import journal, ordered, taste
from loomlog.operators.parse_failures import line_reason, valid_records
from loomlog.plans.sql import RECORDS, VALID
from loomlog.tables import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _events(spark, d, *columns: str) -> DataFrame:
    """session_lines as events with some of their columns: the file stands for the session; lines stored twice count once, the first by
    line_id."""
    first = F.min_by(F.struct("line_id", *columns), "line_id").alias("x")
    return table(spark, d, "session_lines").groupBy("file_id", "generation", (F.col("line_number") - 1).alias("seq")).agg(first).select("file_id", "generation", "seq", "x.*")


_EVENTS = "e as (select * from (select *, line_number - 1 as seq, row_number() over (partition by file_id, generation, line_number order by line_id) as rn from session_lines) where rn = 1)"


@query("select (select count(*) from sessions) as sessions, (select count(*) from session_lines) as events, (select count(*) from error_records) as errors")
def journal_status(spark, d):
    return journal.status(table(spark, d, "sessions"), table(spark, d, "session_lines"), table(spark, d, "error_records"))


@query(
    """select origin, source, count(*) as n, min(id) as first_id from (select 'source_files' as origin, source, source_session_id as id from source_files
    union all select 'sessions', source, source_session_id from sessions union all select 'store_sessions', source, store_session_id from store_sessions) group by all"""
)
def union_sources(spark, d):
    """The listings of all sources as one."""
    of = lambda name, key: table(spark, d, name).select(F.lit(name).alias("origin"), "source", F.col(key).alias("id"))
    whole = of("source_files", "source_session_id").unionByName(of("sessions", "source_session_id")).unionByName(of("store_sessions", "store_session_id"))
    return whole.groupBy("origin", "source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("select source, path, count(*) as files from source_files group by source, path")
def distinct_paths(spark, d):
    return table(spark, d, "source_files").groupBy("source", "path").agg(F.count(F.lit(1)).alias("files"))


@query("select s.session_id, s.source_session_id, p.source_session_id as parent_source_session_id from sessions s left join sessions p on s.parent_session_id = p.session_id")
def sessions_with_parent(spark, d):
    s = table(spark, d, "sessions")
    parents = s.select(F.col("session_id").alias("parent_session_id"), F.col("source_session_id").alias("parent_source_session_id"))
    return s.select("session_id", "source_session_id", "parent_session_id").join(parents, "parent_session_id", "left").drop("parent_session_id")


@query("select p.session_id as parent_id, c.session_id as child_id, c.source_session_id from sessions p join sessions c on c.parent_session_id = p.session_id")
def parent_children(spark, d):
    s = table(spark, d, "sessions")
    children = s.select(F.col("parent_session_id").alias("parent_id"), F.col("session_id").alias("child_id"), "source_session_id").where("parent_id is not null")
    return children.join(s.select(F.col("session_id").alias("parent_id")), "parent_id", "left_semi")


@query("select t.row_id, t.store_session_id, t.directory, p.sessions from store_sessions t left join (select cwd, count(*) as sessions from sessions where cwd is not null group by cwd) p on t.directory = p.cwd")
def session_project_left(spark, d):
    projects = table(spark, d, "sessions").where("cwd is not null").groupBy(F.col("cwd").alias("directory")).agg(F.count(F.lit(1)).alias("sessions"))
    return table(spark, d, "store_sessions").select("row_id", "store_session_id", "directory").join(projects, "directory", "left")


@query(
    """select f.file_id, i.session_id as id_session, p.path_session from source_files f
    left join sessions i on i.source = f.source and i.source_session_id = f.source_session_id
    left join (select source, file_path, min(session_id) as path_session from sessions where file_path is not null group by 1, 2) p on p.source = f.source and p.file_path = f.path"""
)
def lookup_files(spark, d):
    return journal.lookup_files(table(spark, d, "source_files"), table(spark, d, "sessions")).select("file_id", "id_session", "path_session")


@query("select t.backup_id, t.trigger_event_ref, e.example_id from file_timelines t left join (select source_session_id, tool_use_id, min(example_id) as example_id from preference_examples group by 1, 2) e on e.source_session_id = t.source_session_id and e.tool_use_id = t.trigger_event_ref")
def trigger_left(spark, d):
    """Each state with the proposal that it names, if that is known."""
    found = table(spark, d, "preference_examples").where("source_session_id is not null and tool_use_id is not null").groupBy("source_session_id", F.col("tool_use_id").alias("trigger_event_ref")).agg(F.min("example_id").alias("example_id"))
    return table(spark, d, "file_timelines").select("backup_id", "source_session_id", "trigger_event_ref").join(found, ["source_session_id", "trigger_event_ref"], "left").drop("source_session_id")


def _on_files(spark, d):
    """Proposals (kind p) and states (kind s) of each file, in one order: at the same event a state comes first, then by id."""
    e = table(spark, d, "preference_examples").where("file_path is not null").select("source_session_id", "file_path", F.col("proposal_event_seq").alias("at"), F.lit("p").alias("kind"), F.col("example_id").alias("id"), F.col("tool_use_id").alias("ref"))
    t = table(spark, d, "file_timelines").where("file_path is not null").select("source_session_id", "file_path", F.col("event_seq").alias("at"), F.lit("s").alias("kind"), F.col("backup_id").alias("id"), F.lit(None).cast("string").alias("ref"))
    return ordered.numbered(e.unionByName(t), ["source_session_id", "file_path"], [F.col("at"), F.desc("kind"), F.col("id")], "n", stored)


def _with_content(spark, d, proposals: DataFrame, name: str) -> DataFrame:
    """The proposals (id, state) with whether there is that state, and its content."""
    contents = table(spark, d, "file_timelines").select(F.col("backup_id").alias("state"), "content")
    return proposals.join(contents, "state", "left").select(F.col("id").alias("example_id"), F.col("state").isNotNull().alias("found"), F.col("content").alias(name))


_ON_FILES = """o as (select *, row_number() over (partition by source_session_id, file_path order by pos nulls first, kind desc, id) as n from (
    select source_session_id, file_path, proposal_event_seq as pos, 'p' as kind, example_id as id, tool_use_id as ref, null as content from preference_examples where file_path is not null
    union all select source_session_id, file_path, event_seq, 's', backup_id, null, content from file_timelines where file_path is not null))"""


@query(f"with {_ON_FILES} select id as backup_id, trigger_ref from (select *, last_value(ref ignore nulls) over (partition by source_session_id, file_path order by n rows between unbounded preceding and 1 preceding) as trigger_ref from o) where kind = 's'")
def trigger_asof(spark, d):
    """Each state with the latest proposal before it on the same file."""
    rows = ordered.last_before(_on_files(spark, d), ["source_session_id", "file_path"], "n", F.col("ref"), "trigger_ref")
    return rows.where("kind = 's'").select(F.col("id").alias("backup_id"), "trigger_ref")


@query(
    f"""with {_ON_FILES} select id as example_id, s is not null as found, s.c as before_content from (select *, last_value(case when kind = 's' then {{'c': content}} end ignore nulls)
    over (partition by source_session_id, file_path order by n rows between unbounded preceding and 1 preceding) as s from o) where kind = 'p'"""
)
def before_state_asof(spark, d):
    """Each proposal with the state before it: found and null isn't not found."""
    rows = ordered.last_before(_on_files(spark, d), ["source_session_id", "file_path"], "n", F.when(F.col("kind") == "s", F.col("id")), "state")
    return _with_content(spark, d, rows.where("kind = 'p'").select("id", "state"), "before_content")


@query(
    f"""with {_ON_FILES} select id as example_id, s is not null as found, s.c as later_content from (select *, first_value(case when kind = 's' then {{'c': content}} end ignore nulls)
    over (partition by source_session_id, file_path order by n rows between 1 following and unbounded following) as s from o) where kind = 'p'"""
)
def post_apply_temporal(spark, d):
    rows = ordered.next_after(_on_files(spark, d), ["source_session_id", "file_path"], "n", F.when(F.col("kind") == "s", F.col("id")), "state")
    return _with_content(spark, d, rows.where("kind = 'p'").select("id", "state"), "later_content")


@query("select source, source_session_id, file_path, trigger_event_ref as tool_ref, arg_min({'c': content}, seq).c as applied from file_timelines where trigger_event_ref is not null group by all")
def post_apply_trigger(spark, d):
    rows = taste.first_by_trigger(table(spark, d, "file_timelines"))
    return rows.withColumn("applied", F.col("applied.content"))


@query("select source, source_session_id, file_path, arg_max({'c': content}, seq).c as final from file_timelines group by all")
def final_state(spark, d):
    return taste.final_states(table(spark, d, "file_timelines"))


@query("select example_id, coalesce(tool_use_id in (select tool_use_id from preference_examples where evidence_kind = 'permission_denial' and tool_use_id is not null), false) as denied from preference_examples")
def denied_semi(spark, d):
    e = table(spark, d, "preference_examples")
    denied = e.where("evidence_kind = 'permission_denial' and tool_use_id is not null").select("tool_use_id").distinct().withColumn("denied", F.lit(True))
    return e.select("example_id", "tool_use_id").join(denied, "tool_use_id", "left").select("example_id", F.coalesce("denied", F.lit(False)).alias("denied"))


@query("select example_id, tool_use_id from preference_examples e where exists (select 1 from file_timelines t where t.trigger_event_ref = e.tool_use_id)")
def executed_exists(spark, d):
    return table(spark, d, "preference_examples").select("example_id", "tool_use_id").join(table(spark, d, "file_timelines").select(F.col("trigger_event_ref").alias("tool_use_id")), "tool_use_id", "left_semi")


@query("select distinct file_id, line_number, raw_line from session_lines n where generation = 1 and not exists (select 1 from session_lines o where o.generation = 0 and o.file_id = n.file_id and o.line_number = n.line_number and o.raw_line = n.raw_line)")
def new_events_anti(spark, d):
    """The lines that a rewritten file has and its first generation hadn't at the same place."""
    lines = table(spark, d, "session_lines").select("file_id", "line_number", "raw_line", "generation")
    key = ["file_id", "line_number", "raw_line"]
    return journal.new_events(lines.where("generation = 1").drop("generation"), lines.where("generation = 0"), key)


@query("select outcome, count(*) as n from preference_examples group by outcome")
def outcome_counts(spark, d):
    return table(spark, d, "preference_examples").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("select evidence_kind, count(*) as n from preference_examples group by evidence_kind")
def evidence_counts(spark, d):
    return table(spark, d, "preference_examples").groupBy("evidence_kind").agg(F.count(F.lit(1)).alias("n"))


_EVIDENCE = ("direct_edit", "direct_write", "bash_correlation", "mcp_correlation", "permission_denial", "missing_final_state")


@query(
    "select count(*) as examples, "
    + ", ".join(f"count(*) filter (outcome = '{o}') as {o}" for o in ("accepted", "rejected", "edited"))
    + ", count(*) filter (confidence >= 1.0) as high_confidence, case when count(*) = 0 then 0.0 else count(*) filter (confidence >= 1.0) / count(*) * 100 end as high_percent, "
    + ", ".join(f"count(*) filter (evidence_kind = '{k}') as {k}" for k in _EVIDENCE)
    + " from preference_examples"
)
def taste_status(spark, d):
    return taste.status(table(spark, d, "preference_examples"))


@query("select session_id, min(event_ts) as first_ts, max(event_ts) as last_ts, count(*) as n from chat_messages group by session_id")
def session_bounds(spark, d):
    return journal.bounds(table(spark, d, "chat_messages"), ["session_id"], "event_ts")


@query("select file_id, arg_min(cwd, {'g': generation, 'l': line_number, 'i': line_id}) as first_cwd from session_lines where cwd is not null group by file_id")
def first_cwd(spark, d):
    return journal.first_known(table(spark, d, "session_lines"), ["file_id"], "cwd", ["generation", "line_number", "line_id"])


@query("select file_id, generation, count(*) as n from session_lines group by file_id, generation")
def generation_counts(spark, d):
    return table(spark, d, "session_lines").groupBy("file_id", "generation").agg(F.count(F.lit(1)).alias("n"))


@query(
    """select p.session_id, cast(coalesce(p.event_count, 0) + coalesce(c.n, 0) as bigint) as event_count from sessions p
    left join (select parent_session_id, sum(event_count) as n from sessions where parent_session_id is not null group by 1) c on c.parent_session_id = p.session_id where p.parent_session_id is null"""
)
def merged_event_count(spark, d):
    return journal.family_event_count(table(spark, d, "sessions"))


def _encoded(spark, d) -> DataFrame:
    """The lines as stored events with payload, codec and payload_size; those of rewritten files (generation 1) have a codec that isn't
    supported."""
    lines = table(spark, d, "session_lines").select("line_id", "file_id", "generation", F.col("raw_line").cast("binary").alias("original"))
    rows = lines.withColumn("e", codec.encode("original")).select("*", "e.*").drop("e")
    return rows.withColumn("codec", F.when(F.col("generation") == 1, "lz4").otherwise(F.col("codec")))


_CODEC = "case when generation = 1 then 'lz4' when strlen(raw_line) >= 1024 then 'zstd' else 'raw' end"


@query(
    f"""select count(*) filter (codec = 'raw') as raw_events, count(*) filter (codec = 'zstd') as zstd_events, count(*) filter (codec = 'lz4') as unsupported_events,
    count(*) filter (codec = 'raw' and strlen(raw_line) < 1024) as small_events from (select *, {_CODEC} as codec from session_lines)"""
)
def codec_stats(spark, d):
    """The counters over encoded payloads; the stored bytes depend on the codec and are left to tests."""
    return journal.codec_stats(_encoded(spark, d)).drop("stored_bytes")


@query("select source, count(*) filter (strlen(text) < 1024) as small, cast(coalesce(sum(strlen(text)), 0) as bigint) as bytes from documents group by source")
def small_payloads(spark, d):
    size = F.octet_length("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(size < 1024).alias("small"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


@query("select line_id, row_number() over (partition by file_id, generation order by line_number, line_id) - 1 as seq from session_lines")
def event_seq(spark, d):
    rows = table(spark, d, "session_lines").select("line_id", "file_id", "generation", "line_number")
    return ordered.numbered(rows, ["file_id", "generation"], [F.col("line_number"), F.col("line_id")], "seq", stored).select("line_id", "seq")


@query("select row_id, row_number() over (partition by source order by time_created nulls first, row_id) - 1 as seq from store_sessions")
def snapshot_seq(spark, d):
    rows = table(spark, d, "store_sessions").select("row_id", "source", "time_created")
    return ordered.numbered(rows, ["source"], [F.col("time_created").asc_nulls_first(), F.col("row_id")], "seq", stored).select("row_id", "seq")


@query("select row_id, row_number() over (partition by session_id order by coalesce(event_ts, ''), seq, is_sidechain, row_id) - 1 as merged_seq from chat_messages")
def merge_streams(spark, d):
    """One stream of each session's main and side chains, by time as text."""
    rows = table(spark, d, "chat_messages").select("row_id", "session_id", "event_ts", "seq", "is_sidechain")
    order = [F.coalesce("event_ts", F.lit("")), F.col("seq").asc_nulls_last(), F.col("is_sidechain").asc_nulls_last(), F.col("row_id")]
    return ordered.numbered(rows, ["session_id"], order, "merged_seq", stored).select("row_id", "merged_seq")


@query("select backup_id, count(*) over (partition by source_session_id, file_path order by event_seq rows between unbounded preceding and 1 preceding) as file_seq from (select *  from file_timelines where event_seq is not null) qualify true")
def file_seq(spark, d):
    rows = table(spark, d, "file_timelines").where("event_seq is not null").select("backup_id", "source_session_id", "file_path", "event_seq")
    return ordered.count_before(rows, ["source_session_id", "file_path"], "event_seq", F.lit(True), "file_seq").select("backup_id", "file_seq")


@query("select example_id, row_number() over (partition by source, source_session_id order by proposal_event_seq, example_id) - 1 as ordinal from preference_examples")
def proposal_ordinal(spark, d):
    rows = table(spark, d, "preference_examples").select("example_id", "source", "source_session_id", "proposal_event_seq")
    return ordered.numbered(rows, ["source", "source_session_id"], [F.col("proposal_event_seq").asc_nulls_last(), F.col("example_id")], "ordinal", stored).select("example_id", "ordinal")


@query(
    """with m as (select *, row_number() over (partition by session_id order by seq, row_id) as n from chat_messages)
    select row_id, string_agg(line, '\n' order by k) as prior from (select m.row_id, p.n as k, concat('[', coalesce(p.msg_role, 'unknown'), ' ', p.row_id, ']') as line
    from m join m p on p.session_id = m.session_id and p.n between m.n - 5 and m.n - 1) group by row_id"""
)
def prior_five(spark, d):
    """The last five messages before each message; the first of a session has none."""
    rows = table(spark, d, "chat_messages").select("row_id", "session_id", "seq", "msg_role")
    rows = ordered.numbered(rows, ["session_id"], [F.col("seq").asc_nulls_last(), F.col("row_id")], "n", stored)
    line = F.concat(F.lit("["), F.coalesce("msg_role", F.lit("unknown")), F.lit(" "), F.col("row_id").cast("string"), F.lit("]"))
    found = ordered.values_before(rows.where("session_id is not null"), ["session_id"], "n", line, 5, "lines")
    return found.where(F.size("lines") > 0).select("row_id", F.array_join("lines", "\n").alias("prior"))


@query("select session_id, strftime(epoch_ms(case when abs(file_mtime) >= 1e10 then file_mtime else file_mtime * 1000 end), '%Y-%m-%dT%H:%M:%S.%gZ') as mtime_iso from sessions where file_mtime is not null")
def epoch_iso(spark, d):
    return table(spark, d, "sessions").where("file_mtime is not null").select("session_id", text.epoch_iso(text.epoch_ms(F.col("file_mtime"))).alias("mtime_iso"))


@query("select record_id, report_file, record_no, read_at from error_records order by read_at desc nulls last, record_id desc limit 50")
def recent_errors(spark, d):
    rows = table(spark, d, "error_records").select(F.col("record_id").alias("id"), "report_file", "record_no", F.col("read_at").alias("last_seen_at"))
    return journal.recent_errors(rows).withColumnsRenamed({"id": "record_id", "last_seen_at": "read_at"})


_PAGE = "select s.session_id, s.source, s.source_session_id, p.source_session_id as parent_source_session_id, s.started_at, s.updated_at, s.event_count from sessions s left join sessions p on p.session_id = s.parent_session_id"


@query(f"{_PAGE} order by coalesce(s.started_at, s.updated_at) desc nulls last, s.session_id desc limit 51 offset 50")
def sessions_page(spark, d):
    return journal.sessions_page(table(spark, d, "sessions"), offset=50)


@query(
    f"{_PAGE} where contains(lower(coalesce(s.source, '')), '_cli') or contains(lower(coalesce(s.source_session_id, '')), '_cli') or contains(lower(coalesce(s.cwd, '')), '_cli') or contains(lower(coalesce(s.file_path, '')), '_cli')"
    " order by coalesce(s.started_at, s.updated_at) desc nulls last, s.session_id desc limit 51"
)
def literal_search(spark, d):
    """The underscore is no wildcard."""
    return journal.sessions_page(table(spark, d, "sessions"), search="_CLI")


@query(f"with {_EVENTS} select file_id, generation, seq, source, cwd, line_id from e order by generation, seq, file_id limit 26 offset 25")
def events_page(spark, d):
    return journal.page(_events(spark, d, "source", "cwd"), [F.col("generation"), F.col("seq"), F.col("file_id")], journal.EVENT_PAGE, 25)


@query(f"with {_EVENTS} select file_id, generation, seq from e order by file_id, generation, seq limit 1 offset 999")
def nth_bound(spark, d):
    return journal.nth(_events(spark, d).select("file_id", "generation", "seq"), ["file_id", "generation", "seq"], 1000)


@query(f"with {_EVENTS} select file_id, generation, seq from e where (file_id, generation, seq) > (100, 0, 3) order by file_id, generation, seq limit 1000")
def keyset_batch(spark, d):
    keys = ["file_id", "generation", "seq"]
    rows = _events(spark, d).select(*[F.col(k).cast("long").alias(k) for k in keys])
    return journal.after(rows, keys, (100, 0, 3))


@query("select source, source_session_id, generation, proposal_event_seq, context, case when outcome in ('accepted', 'edited') then proposal_content end as chosen, case when outcome not in ('accepted', 'edited') then proposal_content end as rejected from preference_examples")
def export_triples(spark, d):
    return taste.triples(table(spark, d, "preference_examples"))


@query("select file_path, seq, event_seq, source_kind from file_timelines where (source_session_id, file_path) = (select min((source_session_id, file_path)) from file_timelines where source_session_id is not null and file_path is not null)")
def show_timeline(spark, d):
    """The timeline of one file of one session: the least of all."""
    rows = table(spark, d, "file_timelines")
    first = rows.where("source_session_id is not null and file_path is not null").agg(F.min(F.struct("source_session_id", "file_path")).alias("first")).select("first.*")
    return rows.join(first, ["source_session_id", "file_path"]).select("file_path", "seq", "event_seq", "source_kind")


_LINES = "(case when {0} = '' then [] else string_split(replace(regexp_replace({0}, '\\r?\\n$', ''), chr(13) || chr(10), chr(10)), chr(10)) end)"
_STATES = "s as (select backup_id, content, lag(content) over (partition by source_session_id, file_path order by seq, backup_id) as old from file_timelines where content is not null)"


def _states(spark, d) -> DataFrame:
    """(backup_id, source_session_id, file_path, n, old_id): each known state and the known one before it on its file, without contents."""
    rows = table(spark, d, "file_timelines").where("content is not null").select("backup_id", "source_session_id", "file_path", "seq")
    key = ["source_session_id", "file_path"]
    rows = stored(ordered.numbered(rows, key, [F.col("seq"), F.col("backup_id")], "n", stored), "states")
    return ordered.last_before(rows, key, "n", F.col("backup_id"), "old_id")


def _contents(spark, d, key: str, name: str) -> DataFrame:
    return table(spark, d, "file_timelines").where("content is not null").select(F.col("backup_id").alias(key), F.col("content").alias(name))


@query(f"select backup_id, len({_LINES.format('content')}) as n_lines from file_timelines where content is not null")
def split_lines(spark, d):
    return table(spark, d, "file_timelines").where("content is not null").select("backup_id", F.size(text.lines(F.col("content"))).cast("long").alias("n_lines"))


@query(
    f"""with {_STATES}, l as (select backup_id, {_LINES.format('content')} as new_lines, {_LINES.format('old')} as old_lines from s where old is not null)
    select backup_id, len(list_distinct(list_filter(new_lines, lambda x: not list_contains(old_lines, x)))) as added, len(list_distinct(list_filter(old_lines, lambda x: not list_contains(new_lines, x)))) as removed from l"""
)
def line_delta(spark, d):
    """How many distinct lines each state adds to and takes from the one before it."""
    rows = _states(spark, d).where("old_id is not null").join(_contents(spark, d, "old_id", "old"), "old_id").join(_contents(spark, d, "backup_id", "content"), "backup_id")
    return rows.select("backup_id", F.size(text.line_delta(F.col("old"), F.col("content"))).cast("long").alias("added"), F.size(text.line_delta(F.col("content"), F.col("old"))).cast("long").alias("removed"))


@query(
    f"""with {_STATES}, f as (select source_session_id, file_path, arg_max(content, {{'s': seq, 'b': backup_id}}) as fin from file_timelines where content is not null group by all),
    l as (select s.backup_id, {_LINES.format('s.content')} as a, {_LINES.format('s.old')} as b, {_LINES.format('f.fin')} as z from s join file_timelines t using (backup_id) join f on f.source_session_id is not distinct from t.source_session_id and f.file_path is not distinct from t.file_path where s.old is not null),
    x as (select backup_id, list_distinct(list_filter(a, lambda x: not list_contains(b, x))) as added, list_distinct(list_filter(b, lambda x: not list_contains(a, x))) as removed, z from l)
    select backup_id, len(list_filter(added, lambda x: not list_contains(z, x))) = 0 and len(list_filter(removed, lambda x: list_contains(z, x))) = 0 as present,
    len(list_filter(added, lambda x: list_contains(z, x))) > 0 and len(list_filter(added, lambda x: list_contains(z, x))) < len(added) as partial from x"""
)
def effect_present(spark, d):
    """Whether each change of a file is in its last known state, wholly or in part."""
    rows = stored(_states(spark, d), "states")
    key = ["source_session_id", "file_path"]
    last = rows.groupBy(*key).agg(F.max_by("backup_id", "n").alias("final_id"))
    both = rows.where("old_id is not null").join(last, (rows["source_session_id"].eqNullSafe(last["source_session_id"])) & (rows["file_path"].eqNullSafe(last["file_path"]))).select("backup_id", "old_id", "final_id")
    for name, at in (("old", "old_id"), ("content", "backup_id"), ("final", "final_id")):
        both = both.join(_contents(spark, d, at, name), at)
    parts = [F.col(c) for c in ("old", "content", "final")]
    return both.select("backup_id", text.effect_present(*parts).alias("present"), text.partial_effect(*parts).alias("partial"))


@query("select distinct file_id from session_lines where generation = 0 and contains(lower(raw_line), 'exec_command') and strlen(substr(raw_line, 1, instr(lower(raw_line), 'exec_command') - 1)) + 12 <= 4096")
def payload_search(spark, d):
    """Sessions whose payloads hold a text in their first 4096 bytes, as far as they can be decoded."""
    heads = _encoded(spark, d).select(F.col("file_id").alias("session_id"), codec.decode_head(4096)("payload", "codec").alias("head"))
    return journal.payload_hits(heads, "Exec_Command").withColumnRenamed("session_id", "file_id")


@query("select line_id, substr(raw_line, 1, 280) as shown from session_lines")
def payload_preview(spark, d):
    return table(spark, d, "session_lines").select("line_id", text.preview(F.col("raw_line").cast("binary")).alias("shown"))


@query("select session_id, source_session_id from sessions where source = 'claude_cli' and cwd = '/work/forge/atlas-monorepo'")
def optional_filter(spark, d):
    return journal.optional_equal(table(spark, d, "sessions"), source="claude_cli", cwd="/work/forge/atlas-monorepo", file_path=None).select("session_id", "source_session_id")


@query(f"select line_id, {_CODEC} as codec, strlen(raw_line) as payload_size, raw_line is not null as same from session_lines where generation = 0")
def codec_guard(spark, d):
    """The payloads that are read back, guarded: those with another codec aren't among them, and one would fail the query."""
    rows = journal.guarded(_encoded(spark, d).where("generation = 0"))
    return rows.select("line_id", "codec", "payload_size", F.coalesce(codec.decode("payload", "codec") == F.col("original"), F.lit(False)).alias("same"))


@query("select session_id, coalesce(regexp_full_match(source_session_id, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}'), false) as is_uuid from sessions")
def uuid_predicate(spark, d):
    return table(spark, d, "sessions").select("session_id", F.coalesce(text.is_uuid(F.col("source_session_id")), F.lit(False)).alias("is_uuid"))


@query("select tool_name, tool_name in ('Edit', 'Write', 'NotebookEdit', 'Bash') or starts_with(tool_name, 'mcp_') as modifies, count(*) as n from preference_examples group by tool_name")
def file_modifying(spark, d):
    rows = table(spark, d, "preference_examples")
    return rows.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n")).select("tool_name", text.is_file_modifying(F.col("tool_name")).alias("modifies"), "n")


@query(
    """select s.session_id, coalesce(p.source_session_id, substr(left(s.file_path, length(s.file_path) - length('/subagents/' || s.agent || '.jsonl')), -36)) || '/subagents/' || s.agent as source_session_id
    from (select *, regexp_replace(source_session_id, '.*/', '') as agent from sessions where source = 'claude_cli' and contains(source_session_id, 'agent-')) s
    left join (select session_id, case when contains(source_session_id, 'agent-') then regexp_replace(source_session_id, '.*/', '') else source_session_id end as source_session_id from sessions) p on p.session_id = s.parent_session_id where p.source_session_id is not null or s.parent_session_id is null and ends_with(s.file_path, '/subagents/' || s.agent || '.jsonl')
    and regexp_full_match(substr(left(s.file_path, length(s.file_path) - length('/subagents/' || s.agent || '.jsonl')), -36), '.{8}-.{4}-.{4}-.{4}-.{12}')"""
)
def sidechain_ids(spark, d):
    """The qualified ids of side chains, from their own names alone."""
    own = F.regexp_replace("source_session_id", ".*/", "")
    s = table(spark, d, "sessions")
    return journal.sidechain_ids(s.withColumn("source_session_id", F.when(F.contains("source_session_id", F.lit("agent-")), own).otherwise(F.col("source_session_id"))))


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"


@query(f"select doc_id, md5({_ESCAPED}) as escaped, md5(url_encode(text)) as encoded, text as decoded from documents where text is not null")
def page_texts(spark, d):
    """Texts escaped for a page, encoded for an address, and decoded again."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    encoded = text.url_encoded(F.col("text"))
    return rows.select("doc_id", F.md5(text.html_escaped(F.col("text"))).alias("escaped"), F.md5(encoded).alias("encoded"), text.percent_decoded(encoded).alias("decoded"))


@query("select file_id, case when cwd is not null and starts_with(replace(path, '\\', '/'), rtrim(cwd, '/') || '/') then substr(replace(path, '\\', '/'), length(rtrim(cwd, '/')) + 2) else replace(path, '\\', '/') end as path from source_files")
def normalize_path(spark, d):
    return table(spark, d, "source_files").select("file_id", text.normalize_path(F.col("path"), F.col("cwd")).alias("path"))


@query(
    """select example_id, nullif(trim(list_filter(regexp_split_to_array(proposal_content, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: contains(w, '/') or ends_with(w, '.rs') or ends_with(w, '.ts'))[-1], '>"'''), '') as target
    from preference_examples where proposal_content is not null"""
)
def bash_target(spark, d):
    return table(spark, d, "preference_examples").where("proposal_content is not null").select("example_id", text.bash_target(F.col("proposal_content")).alias("target"))


def _at(path: str) -> str:
    return f"case when json_type(j, '$.{path}') = 'VARCHAR' then json_extract_string(j, '$.{path}') end"


@query(
    f"""with {VALID} select line_id, coalesce({_at('timestamp')}, {_at('snapshot.timestamp')}, case source when 'claude_local_agent' then {_at('_audit_timestamp')} when 'codex_cli' then {_at('payload.timestamp')} end) as ts from v"""
)
def event_timestamp(spark, d):
    """The time of an event as text: its own, else its snapshot's, else that of its tool's audit or payload."""
    v = F.try_parse_json("raw_line")
    of = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    lines = table(spark, d, "session_lines").select("line_id", "source", "raw_line").withColumn("reason", line_reason(F.col("raw_line"))).where("reason is null")
    tool = F.when(F.col("source") == "claude_local_agent", of("$._audit_timestamp")).when(F.col("source") == "codex_cli", of("$.payload.timestamp"))
    return lines.select("line_id", F.coalesce(of("$.timestamp"), of("$.snapshot.timestamp"), tool).alias("ts"))


@query(
    f"""with {_ON_FILES}, p as (select id as example_id, last_value(case when kind = 's' then {{'c': content}} end ignore nulls) over (partition by source_session_id, file_path order by n rows between unbounded preceding and 1 preceding) as s, kind from o),
    f as (select source, source_session_id, file_path, arg_max({{'c': content}}, seq) as fin, true as tracked from file_timelines group by all),
    a as (select source, source_session_id, file_path, trigger_event_ref, arg_min({{'c': content}}, seq) as applied from file_timelines where trigger_event_ref is not null group by all),
    r as (select e.example_id, e.tool_name as tool, e.file_path, f.tracked, f.fin.c as fin, a.applied.c as post, coalesce(p.s.c, '') as old,
        coalesce(e.tool_use_id in (select tool_use_id from preference_examples where evidence_kind = 'permission_denial' and tool_use_id is not null), false) as denied,
        coalesce(e.tool_use_id in (select trigger_event_ref from file_timelines where trigger_event_ref is not null), false) as executed,
        case when e.tool_name in ('Edit', 'Write', 'NotebookEdit') then 1.0 when e.tool_name = 'Bash' or starts_with(e.tool_name, 'mcp_') then 0.6 else 0.3 end as base,
        case when e.tool_name in ('Edit', 'NotebookEdit') then 'direct_edit' when e.tool_name = 'Write' then 'direct_write' when e.tool_name = 'Bash' then 'bash_correlation'
          when starts_with(e.tool_name, 'mcp_') then 'mcp_correlation' else 'missing_final_state' end as kind
      from preference_examples e left join f using (source, source_session_id, file_path)
      left join a on a.source = e.source and a.source_session_id = e.source_session_id and a.file_path = e.file_path and a.trigger_event_ref = e.tool_use_id
      left join p on p.example_id = e.example_id and p.kind = 'p'),
    l as (select *, list_distinct(list_filter({_LINES.format('post')}, lambda x: not list_contains({_LINES.format('old')}, x))) as added,
        list_distinct(list_filter({_LINES.format('old')}, lambda x: not list_contains({_LINES.format('post')}, x))) as removed, {_LINES.format('fin')} as z from r),
    k as (select *, len(list_filter(added, lambda x: list_contains(z, x))) as there, len(list_filter(removed, lambda x: list_contains(z, x))) as left_over from l),
    b as (select *, case when denied then 'denied' when file_path is null then 'no path' when tracked is null and tool = 'Write' and executed then 'written' when tracked is null then 'untracked' when fin is null then 'no final'
        when post is null then 'no post' when there = len(added) and left_over = 0 then 'all' when there > 0 and there < len(added) then 'part' else 'none' end as what from k)
    select example_id, case what when 'written' then 'accepted' when 'all' then 'accepted' when 'part' then 'edited' else 'rejected' end as outcome,
      cast(case what when 'denied' then 1.0 when 'no path' then 0.2 when 'written' then 0.4 when 'untracked' then 0.3 when 'no final' then 0.3 when 'part' then greatest(base * 0.5, 0.2) else base end as double) as confidence,
      case when what = 'denied' then 'permission_denial' when what in ('no path', 'written', 'untracked', 'no final') then 'missing_final_state' else kind end as evidence_kind from b"""
)
def classify(spark, d):
    """The label of each proposal by the state before it, the states that name it and its file's last state. A proposal counts as denied if one
    of its id is labelled so, and as executed if a state names it."""
    timeline, examples = table(spark, d, "file_timelines"), table(spark, d, "preference_examples")
    key = [*taste.KEYS, "file_path"]
    refs = lambda df, column, name: df.where(F.col(column).isNotNull()).select(F.col(column).alias("tool_ref")).distinct().withColumn(name, F.lit(True))
    rows = (
        examples.withColumnRenamed("tool_use_id", "tool_ref")
        .join(taste.final_states(timeline).withColumn("tracked", F.lit(True)), key, "left")
        .join(taste.first_by_trigger(timeline), [*key, "tool_ref"], "left")
        .join(refs(examples.where("evidence_kind = 'permission_denial'"), "tool_use_id", "denied"), "tool_ref", "left")
        .join(refs(timeline, "trigger_event_ref", "executed"), "tool_ref", "left")
        .join(before_state_asof(spark, d), "example_id", "left")
    )
    flag = lambda c: F.coalesce(c, F.lit(False))
    label = text.classify(F.col("tool_name"), F.col("file_path"), flag("denied"), flag("executed"), flag("tracked"), F.col("before_content"), F.col("applied.content"), F.col("final"))
    return rows.select("example_id", label.alias("l")).select("example_id", "l.*")


@query(
    f"""with {_STATES}, f as (select source, source_session_id, file_path, arg_max({{'c': content}}, seq).c as fin from file_timelines group by all),
    r as (select s.backup_id, t.file_path, f.fin, s.content as post, coalesce(s.old, '') as old, case t.source_kind when 'inline_snapshot' then 'direct_edit' else 'bash_correlation' end as kind, case t.source_kind when 'inline_snapshot' then 1.0 else 0.6 end as base
      from s join file_timelines t using (backup_id) left join f on f.source is not distinct from t.source and f.source_session_id is not distinct from t.source_session_id and f.file_path is not distinct from t.file_path),
    l as (select *, list_distinct(list_filter({_LINES.format('post')}, lambda x: not list_contains({_LINES.format('old')}, x))) as added,
        list_distinct(list_filter({_LINES.format('old')}, lambda x: not list_contains({_LINES.format('post')}, x))) as removed, {_LINES.format('fin')} as z from r),
    k as (select *, len(list_filter(added, lambda x: list_contains(z, x))) as there, len(list_filter(removed, lambda x: list_contains(z, x))) as left_over from l),
    b as (select *, case when file_path is null then 'no path' when fin is null then 'no final' when there = len(added) and left_over = 0 then 'all' when there > 0 and there < len(added) then 'part' else 'none' end as what from k)
    select backup_id, case what when 'all' then 'accepted' when 'part' then 'edited' else 'rejected' end as outcome,
      cast(case what when 'no path' then 0.2 when 'no final' then 0.3 when 'part' then greatest(base * 0.5, 0.2) else base end as double) as confidence,
      case when what in ('no path', 'no final') then 'missing_final_state' else kind end as evidence_kind from b"""
)
def classify_states(spark, d):
    """The label that a proposal would get which turned each known state of a file into the next: by Edit for inline states, by Bash for
    others."""
    timeline = table(spark, d, "file_timelines")
    key = [*taste.KEYS, "file_path"]
    last = taste.final_states(timeline)
    rows = (
        _states(spark, d).select("backup_id", "old_id").join(timeline.select("backup_id", "source_kind", "content", *key), "backup_id")
        .join(_contents(spark, d, "old_id", "old"), "old_id", "left")
        .withColumnsRenamed({k: f"own_{k}" for k in key})
    )
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"own_{k}").eqNullSafe(F.col(k))
    rows = rows.join(last, same, "left")
    tool = F.when(F.col("source_kind") == "inline_snapshot", "Edit").otherwise("Bash")
    label = text.classify(tool, F.col("own_file_path"), F.lit(False), F.lit(True), F.lit(True), F.col("old"), F.col("content"), F.col("final"))
    return rows.select("backup_id", label.alias("l")).select("backup_id", "l.*")


@query(
    """select s.session_id, case when s.file_size = f.size and s.content_fingerprint = s.prefix_fingerprint then 'skip' when s.file_size is null then 'append' when f.jsonl and s.next_read_offset > f.size then 'rewrite'
    when f.jsonl and f.size > s.file_size then 'append' else 'rewrite' end as mode
    from sessions s join (select f.source, f.source_session_id, f.format = 'jsonl' as jsonl, coalesce(l.size, 0) as size from source_files f left join (select file_id, cast(sum(strlen(raw_line) + 1) as bigint) as size from session_lines group by 1) l using (file_id)) f
    on f.source = s.source and f.source_session_id = s.source_session_id"""
)
def import_mode(spark, d):
    """What an import would do with each stored session's file, given the size of its lines."""
    sizes = table(spark, d, "session_lines").groupBy("file_id").agg(F.sum(F.octet_length("raw_line") + 1).alias("size"))
    files = table(spark, d, "source_files").select("file_id", "source", "source_session_id", (F.col("format") == "jsonl").alias("jsonl")).join(sizes, "file_id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    rows = table(spark, d, "sessions").join(files, journal.NATURAL)
    same = F.col("content_fingerprint") == F.col("prefix_fingerprint")
    mode = journal.import_mode(F.col("size"), F.col("file_size"), same, F.col("jsonl"), F.col("next_read_offset") <= F.col("size"), F.lit(False), F.col("next_read_offset"))
    return rows.select("session_id", mode.alias("mode"))


@query(
    """select report_file, count(*) as records, cast(sum(case when read_at >= timestamp '2026-01-01' then 1 else 0 end) as bigint) as again, min(read_at) as first_read, max(read_at) as last_read from error_records group by report_file"""
)
def error_reports(spark, d):
    return table(spark, d, "error_records").groupBy("report_file").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("read_at") >= F.lit("2026-01-01").cast("timestamp_ntz")).alias("again"), F.min("read_at").alias("first_read"), F.max("read_at").alias("last_read")
    )


_FIELDS = "nullif(c[1], '') as source, nullif(c[2], '') as source_session_id, nullif(c[3], '') as file_path, try_cast(c[4] as bigint) as generation, try_cast(c[5] as bigint) as byte_offset, try_cast(c[6] as bigint) as line_number, c[7] as error_kind"


def _records(spark, d) -> DataFrame:
    """The valid error records, each once, with the time at which they were first read."""
    records, read = valid_records(table(spark, d, "error_records")), table(spark, d, "error_records").select("record_id", "read_at")
    return records.join(read, "record_id").groupBy(*journal.ERROR_KEY, "message", "first_seen_at", "last_seen_at", "occurrence_count").agg(F.min("read_at").alias("read_at"))


@query(
    f"""with {RECORDS}, e as (select {_FIELDS}, c[8] as message, c[9] as first_seen_at, c[10] as last_seen_at, cast(c[11] as bigint) as occurrence_count, min(read_at) as read_at from records where reason is null group by all),
    p as (select *, case when coalesce(read_at >= timestamp '2026-01-01', true) then 1 else 0 end as pass from e)
    select source, source_session_id, file_path, generation, byte_offset, line_number, error_kind, arg_max(message, {{'p': pass, 'l': last_seen_at, 'm': message}}) as message, min(first_seen_at) as first_seen_at,
      max(last_seen_at) as last_seen_at, cast(sum(occurrence_count) as bigint) as occurrence_count from p group by source, source_session_id, file_path, generation, byte_offset, line_number, error_kind"""
)
def error_upsert(spark, d):
    """The valid error records, folded into one row for each key; the records read before 2026 are stored, the others seen."""
    once = _records(spark, d)
    late = F.coalesce(F.col("read_at") >= F.lit("2026-01-01").cast("timestamp_ntz"), F.lit(True))
    return journal.upsert_errors(once.where(~late).drop("read_at"), once.where(late).drop("read_at"))


@query(
    """with o as (select source, store_session_id as source_session_id, min(directory) as cwd, min(time_created) as started_at, max(time_created) as ended_at, count(*) as n from store_sessions group by 1, 2)
    select coalesce(n.source, s.source) as source, coalesce(n.source_session_id, s.source_session_id) as source_session_id, coalesce(n.cwd, s.cwd) as cwd, least(s.started_at, n.started_at) as started_at,
    greatest(s.ended_at, n.ended_at) as ended_at, coalesce(n.n, s.event_count) as event_count from sessions s full join o n on n.source = s.source and n.source_session_id = s.source_session_id"""
)
def session_upsert(spark, d):
    s = table(spark, d, "sessions").select(*journal.NATURAL, "cwd", "started_at", "ended_at", F.col("current_generation").alias("generation"), "event_count", "next_read_offset")
    t = table(spark, d, "store_sessions").groupBy("source", F.col("store_session_id").alias("source_session_id"))
    new = t.agg(F.min("directory").alias("cwd"), F.min("time_created").alias("started_at"), F.max("time_created").alias("ended_at"), F.lit(0).cast("long").alias("generation"), F.count(F.lit(1)).alias("event_count"), F.lit(0).cast("long").alias("next_read_offset"))
    return journal.merge_sessions(s, new).drop("generation", "next_read_offset")


@query(
    """select count(*) filter (e.n is not null) as done, greatest(0, count(*) - count(*) filter (e.n is not null)) as pending from sessions s
    left join (select source, source_session_id, count(*) as n from preference_examples group by 1, 2) e on e.source = s.source and e.source_session_id = s.source_session_id where s.parent_session_id is null"""
)
def ratio_pending(spark, d):
    done = table(spark, d, "preference_examples").groupBy(*taste.KEYS).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "sessions").where("parent_session_id is null").select(*taste.KEYS).join(done, taste.KEYS, "left")
    finished = F.count_if(F.col("n").isNotNull())
    return rows.agg(finished.alias("done"), F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - finished).alias("pending"))


@query(
    f"""with {RECORDS}, e as (select {_FIELDS}, c[8] as message, c[9] as a, c[10] as b, c[11]::bigint as n from records where reason is null group by all)
    select count(*) as unresolved from e where not exists (select 1 from sessions s where s.source = e.source and s.file_path = e.file_path and s.event_count > 0)"""
)
def doctor(spark, d):
    """The errors that stay unresolved when those of files with stored events are resolved."""
    none = F.lit(None).cast("string")
    errors = _records(spark, d).drop("read_at").withColumns({"resolved_at": none, "resolution_note": none})
    well = table(spark, d, "sessions").where("file_path is not null and event_count > 0").select("source", "file_path")
    fixed = well.join(errors.select("source", "file_path", "error_kind"), ["source", "file_path"])
    return journal.doctor(journal.unresolved(journal.resolve_errors(errors, fixed, F.lit("2026-01-01T00:00:00.000Z"), "read again")))[0]


@query("select path, opened_at from source_files order by path desc nulls last offset 30")
def retention(spark, d):
    """What a retention of 30 would delete; paths are unique."""
    return journal.beyond_newest(table(spark, d, "source_files").select("path", "opened_at"), "path", 30)


@query("select doc_id, strlen(text) as payload_size, true as same from documents where text is not null")
def zstd_roundtrip(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("original"))
    packed = rows.withColumn("e", codec.encode("original"))
    return packed.select("doc_id", F.col("e.payload_size").alias("payload_size"), (codec.decode(F.col("e.payload"), F.col("e.codec")) == F.col("original")).alias("same"))


def _compaction(spark, d) -> DataFrame:
    return table(spark, d, "session_lines").select(codec.plan(F.col("raw_line").cast("binary")).alias("p"), F.octet_length("raw_line").alias("size"))


@query("select case when strlen(raw_line) >= 1024 then 'compact' else 'small' end as action, count(*) as n, cast(sum(strlen(raw_line)) as bigint) as payload_bytes from session_lines group by 1")
def compaction_plan(spark, d):
    """What compaction would do with all lines; lines of JSON always get smaller."""
    return _compaction(spark, d).groupBy(F.col("p.action").alias("action")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("payload_bytes"))


@query()
def compaction_savings(spark, d):
    """The bytes that compaction would save, which are those of the codec."""
    return _compaction(spark, d).groupBy(F.col("p.action").alias("action")).agg(F.sum("p.saved").alias("saved"))


@query()
def taste_examples(spark, d):
    """The whole pipeline over the lines of all files in their last generation: merged streams, timelines, labels."""
    files = table(spark, d, "source_files").select("file_id", "source", "source_session_id", "cwd")
    current = table(spark, d, "session_lines").groupBy("file_id").agg(F.max("generation").alias("generation"))
    lines = _events(spark, d, "raw_line").join(current, ["file_id", "generation"], "left_semi").join(files, "file_id")
    stream = F.split(F.col("source_session_id"), "/subagents/")
    lines = lines.select(
        "source", F.try_element_at(stream, F.lit(1)).alias("source_session_id"), F.when(F.size(stream) > 1, 1).otherwise(0).alias("stream_idx"), F.try_element_at(stream, F.lit(2)).alias("agent_id"),
        F.col("seq").alias("line_seq"), F.col("raw_line").alias("payload"),
    )
    sessions = files.groupBy("source", F.try_element_at(F.split("source_session_id", "/subagents/"), F.lit(1)).alias("source_session_id")).agg(F.min("cwd").alias("cwd"))
    blobs = spark.createDataFrame([], "source_session_id string, backup_name string, blob string")
    return taste.extract(lines, sessions, blobs, stored)[1]
