"""Schemas that drift between files: similarity flooding between observed schema graphs and the watched fields.

An observed schema graph has a node for each path of names through objects (arrays are leaves), its parent, its name and its
types, as deep as the listed paths go. There is one for each schema that files have, many files sharing one. Names that no path can hold
(with a dot or slash, or empty) are counted as left out. All others take part, however many there are: where a parent has more than MAP_NAMES
names in one schema, paths that nothing tells apart share a node with their number, which gives each the score that it would have by itself.
The watched graph holds the paths under which each watched field may stand. Scores flow between the two graphs until they no longer change;
the pairs are then selected from the roots down, each path once, the best scores first. A path that is listed is always selected as itself
(see flood); one that isn't may be selected in place of a listed one that the file doesn't have, and is reported as inferred. A tool's path
belongs to the field that its files' scores are for.

Lines that are no single JSON object, and files without such a line, count for nothing; null values have no type; a null file_id belongs
to no file.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions.strictjson import load_object, type_name
from loomlog.operators import ordered

EPSILON = 1e-6
#: How much of what flows between pairs counts: little enough for a pair of equal paths to stay ahead of all pairs with one of the two.
DAMPING = 0.1
#: A pair is selected from this score on, as a share of the roots' own. Where each listed path was taken from the list in turn, all that were
#: selected got their own field, from a threshold of 0.2 to one of 0.35.
THRESHOLD = 0.25
#: A parent with more names than this in one schema holds data under them. Schemas with such names, and those of more than ONE_BY_ONE paths,
#: are flooded by groups of paths; the selection is that of all paths one by one, so results don't depend on either.
MAP_NAMES = 1_000
ONE_BY_ONE = 10_000
#: So many combinations are counted before they are handed on, to be summed with others of their kind.
COUNTED = 200_000
#: So many lines of a batch are texts in Python at once.
LINES = 500
#: The path of what is left out.
LEFT_OUT = "\x00left out"


def _paths(value: dict, depth: int, prefix: str = "") -> Iterator[tuple[str, str]]:
    for key, inner in value.items():
        if inner is None:
            continue
        if "." in key or "/" in key or not key:
            yield LEFT_OUT, ""
            continue
        yield prefix + key, type_name(inner)
        if depth > 1 and isinstance(inner, dict):
            yield from _paths(inner, depth - 1, f"{prefix}{key}.")


def depth_of(aliases: list[tuple[str, str]]) -> int:
    """How many names the longest listed path has."""
    return max((p.count(".") + 1 for _, p in aliases), default=1)


def observed(lines: DataFrame, depth: int) -> DataFrame:
    """(file_id, source, path, type, n): what each file's counting lines hold; the path '' stands for a counting line, LEFT_OUT for a name that
    no path can hold.

    Each batch of rows is reduced to its distinct combinations before anything is shuffled, COUNTED of them at a time."""

    def counted(seen: dict[tuple, int]) -> pa.RecordBatch:
        columns = list(zip(*seen)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:]), pa.array(list(seen.values()), pa.int64())],
            names=["file_id", "source", "path", "type", "n"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, int] = {}
            for file_id, source, raw in (row for k in range(0, batch.num_rows, LINES) for row in zip(*(c.to_pylist() for c in batch.slice(k, LINES).columns))):
                value = load_object(raw)
                if value is None or file_id is None:
                    continue
                for path, kind in (("", ""), *_paths(value, depth)):
                    key = (file_id, source or "", path, kind)
                    seen[key] = seen.get(key, 0) + 1
                if len(seen) >= COUNTED:
                    yield counted(seen)
                    seen = {}
            yield counted(seen)

    rows = lines.select("file_id", "source", "raw_line").mapInArrow(run, "file_id long, source string, path string, type string, n long")
    return rows.groupBy("file_id", "source", "path", "type").agg(F.sum("n").alias("n"))


def _words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", name)]


def _alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def _spelled(name: str) -> tuple[str, set[str]]:
    """A name's last word, and the three letters from each of its letters on."""
    words = _words(name)
    return words[-1] if words else "", {f" {w} "[i : i + 3] for w in words for i in range(len(w))}


@lru_cache(100_000)
def _named_alike(a: str, b: str) -> float:
    """How alike two names are: the last word says what a value is, the others which one."""
    (x, grams), (y, others) = _spelled(a), _spelled(b)
    return 0.6 * bool(x and x == y) + 0.4 * _alike(grams, others)


def _tree(paths: Iterable[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All prefixes of the paths, the root first; each node's parent; how many children each has."""
    nodes = [""] + sorted({".".join(p.split(".")[:i]) for p in paths for i in range(1, p.count(".") + 2)} - {""})
    at = {p: i for i, p in enumerate(nodes)}
    parent = np.array([0] + [at[p.rpartition(".")[0]] for p in nodes[1:]])
    return nodes, parent, np.maximum(1, np.bincount(parent[1:], minlength=len(nodes)))


def _first_scores(left: list[str], right: list[str], paths: dict[str, set[str]], fields: dict[str, str]) -> np.ndarray:
    """What names and types say: 1 for equal paths, else at most a half. A listed path's types are all that its field is seen with."""
    of_field: dict[str, set[str]] = {}
    for p, f in fields.items():
        of_field.setdefault(f, set()).update(paths.get(p, ()))
    ends = [p.rpartition(".")[2] for p in right]
    first = 0.4 * np.array([[_named_alike(n, m) for m in ends] for n in (p.rpartition(".")[2] for p in left)])
    plain = {"object"}
    kinds = [frozenset(paths.get(a) or plain) for a in left]
    rows: dict[frozenset, np.ndarray] = {}
    for kind in set(kinds):
        rows[kind] = np.array([_alike(wanted, kind) if (wanted := of_field.get(fields[b]) if b in fields else plain) else 0.5 for b in right])
    first += 0.1 * np.array([rows[k] for k in kinds])
    at = {b: j for j, b in enumerate(right)}
    for i, a in enumerate(left):
        if a in at:
            first[i, at[a]] = 1.0
    first[0, 1:] = first[1:, 0] = 0  # a root is like a root only
    return first


def _groups(left: list[str], up: list[int], right: list[str], paths: dict[str, set[str]]) -> tuple[list[int], list[int]]:
    """The group of each node, and the first node of each group.

    Nodes are in one group if their parents are, their first scores are the same, and what is below them is of the same shape: whatever flows
    to one flows to all. A watched path is a group of its own."""
    ends = sorted({p.rpartition(".")[2] for p in right})
    spelled = [_spelled(m) for m in ends]
    grams = set().union(*(g for _, g in spelled))
    some = re.compile("|".join(sorted({g.strip() for g in grams})) or "(?!)")
    watched, plain, names = set(right), {"object"}, {}

    def look(name: str) -> tuple[tuple[bool, float], ...]:
        """How alike a name is to each watched one; few names of data share letters with any."""
        if name not in names:
            x, own = _spelled(name) if some.search(name.lower()) else ("", set())
            names[name] = () if own.isdisjoint(grams) else tuple((x == y, _alike(own, g)) for y, g in spelled)
        return names[name]

    shapes: dict[tuple, int] = {}
    shape: list[int] = [0] * len(left)
    below: dict[int, dict[int, int]] = {}
    for i in range(len(left) - 1, -1, -1):  # a parent stands before its children
        path = left[i]
        own = path if path in watched else (look(path.rpartition(".")[2]), frozenset(paths.get(path) or plain))
        inner = below.pop(i, None)
        shape[i] = shapes.setdefault((own, inner and frozenset(inner.items())), len(shapes))
        if i:
            near = below.setdefault(up[i], {})
            near[shape[i]] = near.get(shape[i], 0) + 1
    group, first, found = [0] * len(left), [0], {}
    for i in range(1, len(left)):
        group[i] = found.setdefault((group[up[i]], shape[i]), len(first))
        if group[i] == len(first):
            first.append(i)
    return group, first


def flood(paths: dict[str, set[str]], aliases: list[tuple[str, str]]) -> list[tuple[str, str, str, float]]:
    """(path, field, listed path, score) of the observed paths that are selected.

    Each round adds to a pair's score its first score and DAMPING times what flows from the pair of parents, shared among the pairs of
    children, and back from the children; scores are divided by the largest until they no longer change. At most 4 flows to a pair and
    first scores of pairs of equal paths are ahead by a half, so that these stay ahead of all pairs with one of their paths. From the
    roots down, the children of each selected pair are paired by falling score, each once, from THRESHOLD times the roots' score on.

    Paths of one group have one row of scores, which counts as often as there are such children of a parent. Of a group no more children are
    paired than there are watched ones, the first by name."""
    fields: dict[str, str] = {}
    for field, path in aliases:
        fields.setdefault(path, field)
    left, up, out_a = _tree(paths)
    right, up_b, out_b = _tree(fields)
    many = len(paths) > ONE_BY_ONE or len(_no_data(paths, aliases)) < len(paths)
    group, ones = _groups(left, up.tolist(), right, paths) if many else (range(len(left)),) * 2
    size = np.bincount(group)
    up_a, out_a = np.asarray(group)[up[ones]], out_a[ones]
    times = (size / size[up_a])[1:, None]
    first = _first_scores([left[i] for i in ones], right, paths, fields)
    share = 1.0 / np.outer(out_a, out_b)
    score = first
    while True:
        total = first + score
        flow = (total * share)[np.ix_(up_a, up_b)]
        flow[0, :] = flow[:, 0] = 0
        np.add.at(flow, (up_a[1:, None], up_b[None, 1:]), times * total[1:, 1:] * share[np.ix_(up_a[1:], up_b[1:])])
        flow[0, 1:] = flow[1:, 0] = 0
        new = total + DAMPING * flow
        new /= new.max()
        if np.abs(new - score).max() < EPSILON:
            break
        score = new
    below_a, below_b = _children(up), _children(up_b)
    chosen, todo = [], [(0, 0)]
    while todo:
        a, b = todo.pop()
        if right[b] in fields:
            chosen.append((left[a], fields[right[b]], right[b], float(score[group[a], b] / score[0, 0])))
        free_b = set(below_b.get(b, ()))
        met: Counter = Counter()
        free_a = set()
        for i in below_a.get(a, ()) if free_b else ():
            if met[group[i]] < len(free_b):
                met[group[i]] += 1
                free_a.add(i)
        near = ((score[group[i]], i) for i in free_a)
        for _, i, j in sorted((-row[j], i, j) for row, i in near for j in free_b if row[j] >= THRESHOLD * score[0, 0]):
            if i in free_a and j in free_b:
                free_a.discard(i)
                free_b.discard(j)
                todo.append((i, j))
    return sorted(x for x in chosen if x[0] in paths)


def _children(up: np.ndarray) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, p in enumerate(up.tolist()[1:], 1):
        found.setdefault(p, []).append(i)
    return found


def _no_data(kinds: dict[str, set[str]], aliases: list[tuple[str, str]]) -> dict[str, set[str]]:
    """A schema without the names that are data; where it lacks any, flood groups the paths."""
    names: dict[str, int] = {}
    for p in kinds:
        up = p.rpartition(".")[0]
        names[up] = names.get(up, 0) + 1
    listed = {".".join(p.split(".")[:i]) for _, p in aliases for i in range(1, p.count(".") + 2)}
    return {p: k for p, k in kinds.items() if p in listed or names[p.rpartition(".")[0]] <= MAP_NAMES}


@lru_cache(1_000)
def _with(kinds: frozenset[str], kind: str) -> frozenset[str]:
    return kinds | {kind}


_SELECTED = "source string, path string, field_name string, listed_path string, score double, files long"


def correspondences(seen: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """(source, path, field_name, listed_path, score, files, listed): one flooding for each schema of an agent tool's files. A path's field is
    that of the largest sum of scores over the files, ties by name; score is their mean."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            sources, schemas, files = batch.columns
            for source, schema, n in zip(sources.to_pylist(), schemas, files.to_pylist()):  # one schema at a time: it can have any number of paths
                kinds: dict[str, frozenset[str]] = {}
                for path, kind in zip(*(schema.values.field(x).to_pylist() for x in ("path", "type"))):
                    kinds[path] = _with(kinds.get(path, frozenset()), kind)
                out += [(source, *row, n) for row in flood(kinds, aliases)]
            types = [pa.string()] * 4 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], names=[x.split()[0] for x in _SELECTED.split(", ")])

    inner = seen.where((F.col("path") != "") & (F.col("path") != LEFT_OUT))
    schemas = inner.groupBy("file_id", "source").agg(F.array_sort(F.collect_set(F.struct("path", "type"))).alias("schema"))
    cores = seen.sparkSession.sparkContext.defaultParallelism  # a schema is a few bytes, but milliseconds of work
    selected = schemas.groupBy("source", "schema").agg(F.count(F.lit(1)).alias("files")).repartition(cores).mapInArrow(run, _SELECTED)
    whole = selected.groupBy("source", "path", "field_name").agg(F.sum(F.col("score") * F.col("files")).alias("total"), F.sum("files").alias("files"), F.max_by("listed_path", F.struct("score", "listed_path")).alias("listed_path"))
    best = F.max_by(F.struct("field_name", "listed_path", (F.col("total") / F.col("files")).alias("score"), "files"), F.struct("total", "field_name"))
    return whole.groupBy("source", "path").agg(best.alias("b")).select("source", "path", "b.*", (F.col("path") == F.col("b.listed_path")).alias("listed"))


def report(seen: DataFrame, matched: DataFrame) -> DataFrame:
    """(source, path, types, n, field_name, listed_path, score, files, listed): each tool's paths with their selection; path is null for the
    names that no path can hold."""
    words = seen.where("path <> ''").groupBy("source", "path").agg(F.array_sort(F.array_remove(F.collect_set("type"), "")).alias("types"), F.sum("n").alias("n"))
    rows = words.join(matched, ["source", "path"], "left")
    return rows.withColumn("path", F.when(F.col("path") != LEFT_OUT, F.col("path"))).select("source", "path", "types", "n", "field_name", "listed_path", "score", "files", "listed")


def file_states(seen: DataFrame, matched: DataFrame) -> DataFrame:
    """(file_id, state, wide): for each file with a counting line its set of (field_name, path, type) under the selected paths that are
    listed, and under all selected paths."""
    chosen = matched.select("source", "path", "field_name", "listed")
    found = F.when(F.col("field_name").isNotNull(), F.struct("field_name", "path", "type"))
    return seen.join(chosen, ["source", "path"], "left").groupBy("file_id").agg(F.collect_set(F.when(F.col("listed"), found)).alias("state"), F.collect_set(found).alias("wide"))


def with_previous(states: DataFrame, files: DataFrame, keep) -> DataFrame:
    """Each file with the states of the file before it under its source_root, by opened_at, ties by file_id. A root may own any share of
    the files: they are numbered over all tasks. Files without a root have no neighbours; a null opened_at is the earliest."""
    rows = keep(states.join(files.where("source_root is not null").select("file_id", "source_root", "opened_at"), "file_id"), "states")
    rows = ordered.numbered(rows, ["source_root"], [F.col("opened_at").asc_nulls_first(), F.col("file_id")], "n", keep)
    return ordered.last_before(rows, ["source_root"], "n", F.struct("file_id", "state", "wide"), "before").drop("n")


def changes(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(file_id, field_name, change, listed, paths_before, paths_after, types_before, types_after): listed changes are those of listed paths
    alone; the others show only where inferred paths count, too."""

    def values(state: str, field: Column, part: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.filter(F.col(state), lambda x: x["field_name"] == field), lambda x: x[part])))

    def sides(column: str) -> Column:
        """Of each field its paths and types before and now."""
        was = f"before.{column}"
        return F.transform(
            F.array(*[F.lit(f) for f in fields]),
            lambda f: F.struct(f.alias("field_name"), values(was, f, "path").alias("p0"), values(column, f, "path").alias("p1"), values(was, f, "type").alias("t0"), values(column, f, "type").alias("t1")),
        )

    def found(column: str, listed: bool) -> Column:
        def of(x: Column) -> Column:
            both = (F.size(x["p0"]) > 0) & (F.size(x["p1"]) > 0)
            kinds = [
                F.when((F.size(x["p0"]) == 0) & (F.size(x["p1"]) > 0), "added"),
                F.when((F.size(x["p0"]) > 0) & (F.size(x["p1"]) == 0), "removed"),
                F.when(both & (x["p0"] != x["p1"]), "renamed"),
                F.when(both & (x["t0"] != x["t1"]), "retyped"),
            ]
            return F.transform(
                F.array_compact(F.array(*kinds)),
                lambda change: F.struct(
                    x["field_name"].alias("field_name"), change.alias("change"), F.lit(listed).alias("listed"), x["p0"].alias("paths_before"), x["p1"].alias("paths_after"), x["t0"].alias("types_before"), x["t1"].alias("types_after")
                ),
            )

        return F.flatten(F.transform(column, of))

    if not fields:
        return rows.select("file_id", F.lit("").alias("field_name"), F.lit("").alias("change"), F.lit(True).alias("listed")).where("false")
    wider = (F.col("state") != F.col("wide")) | (F.col("before.state") != F.col("before.wide"))
    own = rows.where("before is not null").select("file_id", sides("state").alias("own"), F.when(wider, sides("wide")).alias("more"))
    own = own.select("file_id", found("own", True).alias("own"), found("more", False).alias("more"))
    key = lambda x: F.concat_ws("/", x["change"], x["field_name"])
    inferred = F.filter("more", lambda x: ~F.array_contains(F.transform("own", key), key(x)))
    return own.select("file_id", F.explode(F.concat("own", F.coalesce(inferred, F.slice("own", 1, 0)))).alias("c")).select("file_id", "c.*")


def alias_list(field_aliases: DataFrame) -> list[tuple[str, str]]:
    """The fixed table of aliases, as a parameter of the operator."""
    return [(r[0], r[1]) for r in field_aliases.where("field_name is not null and json_path is not null").select("field_name", "json_path").orderBy("field_name", "json_path").collect()]


def drift(lines: DataFrame, files: DataFrame, aliases: list[tuple[str, str]], keep) -> DataFrame:
    """Every change from file to file. keep(df, name) stores what is read more than once."""
    seen = keep(observed(lines, depth_of(aliases)), "schemas")
    matched = keep(correspondences(seen, aliases), "correspondences")
    return changes(with_previous(file_states(seen, matched), files, keep), sorted({f for f, _ in aliases}))


def common_type(types: set[str]) -> str:
    """The type to which all of a field's values can be cast."""
    return {frozenset({"number"}): "double", frozenset({"boolean"}): "boolean"}.get(frozenset(types), "string")


def united(lines: DataFrame, matched: list[tuple[str, str, str, str]]) -> DataFrame:
    """One consistent table of the counting lines: for each field its value cast to the field's common type, its type as found, and its path.

    matched has (source, path, field_name, common type) in order of preference; the first path with a value gives it, objects and arrays as
    JSON text. A value that the cast can't take is null beside its type and path."""
    common = {f: t for _, _, f, t in matched}
    fields = sorted(common)
    routes: dict[str, list[tuple[int, str, list[str]]]] = {}
    for source, path, field, _ in matched:
        routes.setdefault(source, []).append((fields.index(field), path, path.split(".")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(3 + 3 * len(fields))]
            for line_id, file_id, source, raw in zip(*(c.to_pylist() for c in batch.columns)):
                value = load_object(raw, raw_numbers=True)
                if value is None:
                    continue
                found: list = [None] * (3 * len(fields))
                for k, path, steps in routes.get(source or "", ()):
                    if found[3 * k] is not None:
                        continue
                    at = value
                    for step in steps:
                        at = at.get(step) if isinstance(at, dict) else None
                    if at is not None:
                        text = str(at) if isinstance(at, str) else json.dumps(at, ensure_ascii=False)
                        found[3 * k : 3 * k + 3] = text.encode("utf-8", "replace").decode(), type_name(at), path
                for column, x in zip(out, (line_id, file_id, source, *found)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.string()) for i, c in enumerate(out)], names=names)

    plain = [f.replace(".", "_") for f in fields]
    names = ["line_id", "file_id", "source", *[n for p in plain for n in (p, f"{p}_type", f"{p}_path")]]
    schema = ", ".join(f"`{n}` {'long' if i < 2 else 'string'}" for i, n in enumerate(names))
    rows = lines.select("line_id", "file_id", "source", "raw_line").mapInArrow(run, schema)
    return rows.withColumns({p: F.col(p).try_cast(common[f]) for p, f in zip(plain, fields) if common[f] != "string"})
