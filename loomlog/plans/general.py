"""The queries p1, p2, p4, p6 and p7: data processing on the journal's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.operators import forest, instants, nested, parse_failures, schema_drift
from loomlog.plans.sql import BARE, BEYOND, RECORDS, VALID
from loomlog.plans.store import Store
from loomlog.tables import stored, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The changes of listed paths, as the exact check of the selection asks."""
    return p1_changes(spark, d).where("listed").select("file_id", "field_name", "change")


def p1_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change with what was before and after it; those that only inferred paths show aren't listed."""
    aliases = schema_drift.alias_list(table(spark, d, "field_aliases"))
    return schema_drift.drift(table(spark, d, "session_lines"), table(spark, d, "source_files"), aliases, stored)


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    aliases = schema_drift.alias_list(table(spark, d, "field_aliases"))
    seen = stored(schema_drift.observed(table(spark, d, "session_lines"), schema_drift.depth_of(aliases)), "schemas")
    return seen, schema_drift.correspondences(seen, aliases)


def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """The paths of each tool, the field each was matched with, and its score."""
    return schema_drift.report(*_matched(spark, d))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of all lines, inferred paths included. The selected paths are read to the driver: there are as many names for the
    watched fields, not more than the tools have given them."""
    seen, matched = _matched(spark, d)
    rows = schema_drift.report(seen, matched).where("field_name is not null").orderBy("source", F.desc("listed"), F.desc("score"), "path").collect()
    types: dict[str, set[str]] = {}
    for r in rows:
        types.setdefault(r["field_name"], set()).update(r["types"])
    return schema_drift.united(table(spark, d, "session_lines"), [(r["source"], r["path"], r["field_name"], schema_drift.common_type(types[r["field_name"]])) for r in rows])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_rejected(spark, d).select("origin", "record_id", "reason")


def p2_rejected(spark: SparkSession, d: str) -> DataFrame:
    return parse_failures.rejected(table(spark, d, "session_lines"), table(spark, d, "error_records"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return parse_failures.valid_records(table(spark, d, "error_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.occurrences(table(spark, d, "session_lines"))


def p4_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(table(spark, d, "session_lines"))


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(table(spark, d, "session_lines"))


#: The setting that names a journal whose dictionary of instants is read and added to; without it each query parses all texts.
DICTIONARY = "spark.loomlog.dictionary"


def remembered(store: Store, values: DataFrame) -> DataFrame:
    """(raw, zone, instant_us) of the journal's dictionary, to which the texts of values (raw, zone) that it lacks are parsed and added."""
    with store.writing():
        known = store.table("instants")
        store.commit(instants=instants.parsed(values, known))
    return store.table("instants")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str, column: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("origin"), F.col(key).alias("row_id"), F.col(column).alias("raw"), F.col("tz_name").alias("zone"))

    of_lines = instants.line_values(table(spark, d, "session_lines"), table(spark, d, "source_files")).withColumn("origin", F.lit("session_lines"))
    rows = stored(
        of("chat_messages", "row_id", "event_ts")
        .unionByName(of("sessions", "session_id", "started_at"))
        .unionByName(of("store_sessions", "row_id", "time_created"))
        .unionByName(of_lines),
        "timestamps",
    )
    at = spark.conf.get(DICTIONARY, None)
    return instants.normalised(rows, remembered(Store(spark, at), rows) if at else instants.dictionary(rows, stored))


#: So many messages that follow one another by seq are taken to lie close together in their tree.
PLACE_ROWS = 4096


def _links(spark: SparkSession, d: str) -> DataFrame:
    """The three tables of parent-child links as nodes of one forest. Only messages have a hint of what lies close together."""

    def of(name: str, node: str, parent: str, place, order) -> DataFrame:
        return table(spark, d, name).select(
            F.lit(name).alias("origin"), F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent"),
            place.alias("place"), order.alias("ord"), F.lit(1).cast("long").alias("w0"), F.lit(0).cast("long").alias("w1"), F.lit(0).cast("long").alias("tag"),
        )

    near = F.concat_ws("/", F.coalesce("session_id", F.lit("")), F.coalesce(F.floor(F.col("seq") / PLACE_ROWS).cast("string"), F.col("uuid")))
    return (
        of("chat_messages", "uuid", "parent_uuid", near, F.col("seq"))
        .unionByName(of("sessions", "session_id", "parent_session_id", F.col("session_id").cast("string"), F.col("session_id")))
        .unionByName(of("store_sessions", "store_session_id", "parent_session_id", F.col("store_session_id"), F.lit(0).cast("long")))
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = forest.hierarchy(_links(spark, d), stored)
    return rows.select("origin", F.col("node").alias("node_id"), F.coalesce("root", F.lit("")).alias("root_id"), "depth")


def p7_tree(spark: SparkSession, d: str) -> DataFrame:
    """Each node's root, depth and descendants: those of its root with walk_no in (walk_no, walk_no + descendants]."""
    rows = forest.ordered_hierarchy(_links(spark, d), stored)
    return rows.select(
        "origin", F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), F.coalesce("root", F.lit("")).alias("root_id"), "depth", F.col("before").alias("walk_no"), F.col("below0").alias("descendants")
    )


def p7_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each node's path from below the ancestor path_from, whose own path goes before it."""
    return forest.ordered_hierarchy(_links(spark, d), stored).select("origin", F.col("node").alias("node_id"), "path_from", "path")


def p7_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The nodes on cycles, each cycle with its back edge."""
    rows = forest.cycles(forest.hierarchy(_links(spark, d), stored), stored)
    return rows.select("origin", F.col("cycle").alias("cycle_id"), F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "back_edge", "length")


def p7_deepest_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of the deepest node of each table (a report of one node each; of several the least id), one row a node on it."""
    tree = stored(forest.ordered_hierarchy(_links(spark, d), stored), "tree")
    deepest = tree.where("root is not null").groupBy("origin").agg(F.min_by("node", F.struct(-F.col("depth"), "node")).alias("node"))
    return forest.path_of(tree, deepest).select("origin", F.col("node").alias("node_id"), F.col("ancestor").alias("ancestor_id"), "depth")


def p7_largest_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of the root with most of them in each table (a report of one root each; of several the least id)."""
    tree = stored(forest.ordered_hierarchy(_links(spark, d), stored), "tree")
    largest = tree.where("depth = 0").groupBy("origin").agg(F.min_by("node", F.struct(-F.col("below0"), "node")).alias("node"))
    return forest.descendants_of(tree, largest).select("origin", F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "depth")


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p1_matches, p1_table, p2_found, p2_rejected, p2_records, p4_found, p4_bridge, p4_objects, p6_found, p7_found, p7_tree, p7_segments, p7_cycles, p7_deepest_paths, p7_largest_descendants)}

_BLOCKS = """select line_id, {0} as parent_pos, pos, x -> pos as e from (select *, unnest(range(json_array_length(x)::bigint)) as pos from {1} where json_type(x) = 'ARRAY')
        union all select line_id, {0}, 0, x from {1} where json_type(x) = 'OBJECT' or json_type(x) = 'VARCHAR' and (x ->> '$') <> ''"""
_LABEL = "case json_type(e) when 'VARCHAR' then 'text' when 'OBJECT' then case when json_type(e, '$.type') = 'VARCHAR' then e ->> '$.type' else '' end else '' end"
_NAMED = "case when json_type(e) = 'OBJECT' and json_type(e, '$.{0}') = 'VARCHAR' then e ->> '$.{0}' else '' end"

ORACLE_SQL = {
    "p1_found": f"""with {VALID},
      f as (select v.file_id, a.field_name as field, a.json_path as path, json_type(v.j, '$."' || replace(a.json_path, '.', '"."') || '"') as t from v, field_aliases a),
      s as (select file_id, field, list(distinct path order by path) filter (t <> 'NULL') as paths,
        list(distinct case when t in ('VARCHAR', 'OBJECT', 'ARRAY', 'BOOLEAN') then t else 'NUMBER' end order by 1) filter (t <> 'NULL') as types from f where file_id is not null group by file_id, field),
      o as (select s.*, row_number() over w as n, lag(paths) over w as p0, lag(types) over w as t0 from s join source_files using (file_id) where source_root is not null
        window w as (partition by source_root, field order by opened_at nulls first, file_id))
      select file_id, field as field_name, unnest(case when p0 is null and paths is null then [] when p0 is null then ['added'] when paths is null then ['removed']
        else list_filter([case when p0 <> paths then 'renamed' end, case when t0 <> types then 'retyped' end], lambda x: x is not null) end) as change from o where n > 1""",
    "p2_found": f"""with {VALID}, {RECORDS}
      select 'session_lines' as origin, s.line_id as record_id, case when json_valid(s.raw_line) and not regexp_matches({BARE.format('s.raw_line')}, {BEYOND}) then 'not_object' else 'not_json' end as reason
      from session_lines s anti join v on s.line_id = v.line_id
      union all select 'error_records', record_id, reason from records where reason is not null""",
    "p4_found": f"""with {VALID}, m as (select line_id, j -> '$.message.content' as x from v), b as ({_BLOCKS.format('0', 'm')}),
      i as (select line_id, pos as nth, e -> '$.content' as x from b where json_type(e) = 'OBJECT' and json_type(e, '$.type') = 'VARCHAR' and (e ->> '$.type') = 'tool_result'), r as ({_BLOCKS.format('nth', 'i')}),
      t as (select line_id, j -> '$.snapshot.trackedFileBackups' as x from v),
      k as (select line_id, x, unnest(json_keys(x)) as key from t where json_type(x) = 'OBJECT'),
      c as (select line_id, nth, x -> nth -> '$.toolCalls' as x from (select line_id, j -> '$.messages' as x, unnest(range(json_array_length(j, '$.messages')::bigint)) as nth from v where json_type(j, '$.messages') = 'ARRAY')),
      d as (select line_id, j -> '$.todos.todos' as x from v),
      w as (select line_id, 'content_block' as child_table, parent_pos, pos, {_LABEL} as label, e from b union all select line_id, 'result_block', parent_pos, pos, {_LABEL}, e from r
        union all select line_id, 'tracked_file', 0, pos, {_NAMED.format('filePath')}, e from (select line_id, unnest(range(json_array_length(x)::bigint)) as pos, x -> pos as e from t where json_type(x) = 'ARRAY')
        union all select line_id, 'tracked_file', 0, row_number() over (partition by line_id order by key) - 1, key, json_extract(x, '/' || replace(replace(key, '~', '~0'), '/', '~1')) from k
        union all select line_id, 'tool_call', nth, pos, {_NAMED.format('name')}, e from (select line_id, nth, unnest(range(json_array_length(x)::bigint)) as pos, x -> pos as e from c where json_type(x) = 'ARRAY')
        union all select line_id, 'todo', 0, pos, {_NAMED.format('content')}, e from (select line_id, unnest(range(json_array_length(x)::bigint)) as pos, x -> pos as e from d where json_type(x) = 'ARRAY'))
      select line_id, child_table, cast(parent_pos as bigint) as parent_pos, cast(pos as bigint) as pos, label from w where json_type(e) <> 'NULL'""",
    "p7_found": """with recursive {nodes},
      r as (
        select n.origin, n.id, n.id as root, 0 as depth from n left join n as u on u.origin = n.origin and u.id = n.p where u.id is null
        union all select n.origin, n.id, r.root, r.depth + 1 from n join r on n.origin = r.origin and n.p = r.id)
      select n.origin, n.id as node_id, coalesce(r.root, '') as root_id, cast(coalesce(r.depth, -1) as bigint) as depth from n left join r on r.origin = n.origin and r.id = n.id""",
    "p7_tree": """with recursive {nodes}, {walked}
      select n.origin, n.id as node_id, n.p as parent_id, coalesce(t.root, '') as root_id, cast(coalesce(t.depth, -1) as bigint) as depth, t.walk_no, t.descendants
      from n left join t on t.origin = n.origin and t.id = n.id""",
    "p7_cycles": """with recursive {nodes},
      up as (select origin, id, p as now, 1 as steps from n where p is not null union all select up.origin, up.id, n.p, steps + 1 from up join n on n.origin = up.origin and n.id = up.now
        where up.now <> up.id and n.p is not null and steps <= (select count(*) from n)),
      c as (select distinct origin, id from up where now = id),
      w as (select c.origin, c.id, c.id as start, 0 as steps from c union all select w.origin, n.p, w.start, steps + 1 from w join n on n.origin = w.origin and n.id = w.id where n.p <> w.start),
      m as (select origin, start as id, min(id) as cycle_id, count(*) as length from w group by origin, start)
      select m.origin, m.cycle_id, m.id as node_id, n.p as parent_id, n.p = m.cycle_id as back_edge, m.length from m join n on n.origin = m.origin and n.id = m.id""",
    "p7_deepest_paths": """with recursive {nodes}, {walked},
      d as (select origin, arg_min(id, {{'d': -depth, 'i': id}}) as node_id from t group by origin)
      select d.origin, d.node_id, s.i as ancestor_id, cast(s.k - 1 as bigint) as depth from d join t on t.origin = d.origin and t.id = d.node_id, unnest(list_transform(t.path, lambda x, k: {{'i': x.i, 'k': k}})) as u(s)""",
    "p7_largest_descendants": """with recursive {nodes}, {walked},
      d as (select origin, arg_min(id, {{'d': -descendants, 'i': id}}) as node_id from t where depth = 0 group by origin)
      select d.origin, d.node_id, t.id as descendant_id, cast(t.depth as bigint) as depth from d join t on t.origin = d.origin and t.root = d.node_id and t.id <> d.node_id""",
}
_NODES = """n as (
        select 'chat_messages' as origin, uuid as id, min(parent_uuid) as p, min(seq) as o from chat_messages where uuid is not null group by uuid
        union all select 'sessions', cast(session_id as varchar), min(cast(parent_session_id as varchar)), session_id from sessions group by session_id
        union all select 'store_sessions', store_session_id, min(parent_session_id), 0 from store_sessions where store_session_id is not null group by store_session_id)"""
_WALKED = """r as (
        select n.origin, n.id, n.id as root, 0 as depth, [{'o': n.o is null, 'k': coalesce(n.o, 0), 'i': n.id}] as path from n left join n as u on u.origin = n.origin and u.id = n.p where u.id is null
        union all select n.origin, n.id, r.root, r.depth + 1, list_append(r.path, {'o': n.o is null, 'k': coalesce(n.o, 0), 'i': n.id}) from n join r on n.origin = r.origin and n.p = r.id),
      k as (select *, row_number() over (partition by origin, root order by path) - 1 as walk_no from r),
      e as (select a.origin, a.id, min(b.walk_no) as stop from k a left join k b on b.origin = a.origin and b.root = a.root and b.walk_no > a.walk_no and b.depth <= a.depth group by a.origin, a.id),
      z as (select origin, root, count(*) as size from k group by origin, root),
      t as (select k.*, coalesce(e.stop, z.size) - k.walk_no - 1 as descendants from k join e using (origin, id) join z using (origin, root))"""
ORACLE_SQL |= {name: sql.format(nodes=_NODES, walked=_WALKED) for name, sql in ORACLE_SQL.items() if name.startswith("p7_")}
