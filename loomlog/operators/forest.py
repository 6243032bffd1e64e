"""Parent-child links to full hierarchies: root, depth, order, path and descendants of each node, cycles kept apart.

Nodes are co-located in buckets of about BUCKET_ROWS rows by their place (a hint of what lies close together in the trees); a
place with more rows is split by hash. In each bucket an iterative walk with node colours contracts every local component to
its top. What links tops across buckets is followed by pointer doubling on the contracted graph, whose tables are written to
the shared folder each round: the number of rounds is the logarithm of the depth in tops. No tree needs to fit into one task.

A node whose parent is null or doesn't exist is a root. Nodes on a cycle or below one have no root; cycles() gives each cycle with its
back edge. A full path is given in segments; path_of() and descendants_of() write paths and descendants out for chosen nodes (for all of
them both grow with the square of the depth). Of repeated nodes the least
parent counts; rows without a node id are ignored; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators import ordered

BUCKET_ROWS = 20_000
#: So many children of one node, at most, are put in order together.
CHILDREN = 5_000
#: A path is given from the nearest node above whose depth below its local top is a multiple of this.
LANDMARK = 16

_NODE = "origin string, node string, parent string, place string, ord long, w0 long, w1 long, tag long, real string, step long"
_LOCAL = _NODE.replace("place string", "bucket long") + ", top string, up long, ext string, cyclic boolean, t0 long, t1 long"


def _parents(origins: list, nodes: list, parents: list) -> list[int]:
    at = {key: i for i, key in enumerate(zip(origins, nodes))}
    return [-1 if p is None else at.get((o, p), -1) for o, p in zip(origins, parents)]


def _colour(up: list[int], step: list[int]) -> tuple[list[int], list[int]]:
    """Each node's local top and its depth below it, step counting for a node's own level; -1 on cycles and below them."""
    n = len(up)
    colour, top, depth = bytearray(n), [-1] * n, [-1] * n
    for start in range(n):
        if colour[start]:
            continue
        trail, at = [], start
        while at >= 0 and not colour[at]:
            colour[at] = 1
            trail.append(at)
            at = up[at]
        if at < 0:
            head, level = trail[-1], -step[trail[-1]]
        elif colour[at] == 1:  # a back edge
            head, level = -1, 0
        else:
            head, level = top[at], depth[at]
        for x in reversed(trail):
            colour[x] = 2
            if head >= 0:
                level += step[x]
                top[x], depth[x] = head, level
    return top, depth


def _contract(bucket: pa.Table) -> pa.Table:
    columns = {c: bucket[c].to_pylist() for c in bucket.column_names}
    nodes, parents = columns["node"], columns["parent"]
    top, depth = _colour(_parents(columns["origin"], nodes, parents), columns["step"])
    sums = {"w0": [None] * len(nodes), "w1": [None] * len(nodes)}
    for w, total in sums.items():
        for i, t in enumerate(top):
            if t >= 0:
                total[t] = (total[t] or 0) + columns[w][i]
    columns |= {
        "top": [nodes[t] if t >= 0 else None for t in top],
        "up": depth,
        "ext": [parents[t] if t >= 0 else None for t in top],
        "cyclic": [t < 0 for t in top],
        "t0": sums["w0"],
        "t1": sums["w1"],
    }
    return pa.table({c: pa.array(columns[c], _arrow(c)) for c in [x.split()[0] for x in _LOCAL.split(", ")]})


def _arrow(column: str) -> pa.DataType:
    if column in ("origin", "node", "parent", "real", "top", "ext", "root", "path_from"):
        return pa.string()
    return pa.bool_() if column in ("cyclic", "missing") else pa.list_(pa.string()) if column == "path" else pa.int64()


def _spread(rows: DataFrame, keep) -> DataFrame:
    """The nodes, where no node has more than CHILDREN children: those of a crowded one are put, CHILDREN at a time in their order, below
    helpers that count for no level and no weight; helpers of helpers where there are too many. `real` keeps the parent."""
    level = 0
    while True:
        crowded = rows.where("parent is not null").groupBy("origin", "parent").count().where(F.col("count") > CHILDREN)
        crowded = keep(crowded.join(rows.select("origin", F.col("node").alias("parent")), ["origin", "parent"], "left_semi").select("origin", "parent"), "crowded")
        if not crowded.limit(1).count():
            return rows
        level += 1
        many = rows.join(crowded, ["origin", "parent"], "left_semi").select(rows.columns)
        many = ordered.numbered(many, ["origin", "parent"], [F.col("ord").asc_nulls_last(), F.col("node")], "nth", keep)
        helper = F.concat("parent", F.lit(f"\x00{level}\x00"), F.floor(F.col("nth") / CHILDREN).cast("string"))
        many = keep(many.withColumn("helper", helper), "helped")
        zero = F.lit(0).cast("long")
        helpers = many.groupBy("origin", F.col("helper").alias("node")).agg(
            F.min("parent").alias("parent"), F.min("place").alias("place"), F.floor(F.min("nth") / CHILDREN).alias("ord"), zero.alias("w0"), zero.alias("w1"), zero.alias("tag"),
            F.substring_index(F.min("parent"), "\x00", 1).alias("real"), zero.alias("step"),
        )
        below = many.withColumn("parent", F.col("helper")).select(rows.columns)
        others = rows.join(crowded, ["origin", "parent"], "left_anti").select(rows.columns)
        rows = keep(others.unionByName(below).unionByName(helpers.select(rows.columns)), "spread")


def local_components(nodes: DataFrame, keep, spread: bool = False) -> DataFrame:
    """Every node with its local top, its depth below it, and the parent that the top has elsewhere."""
    rows = keep(
        nodes.where("node is not null")
        .groupBy("origin", "node")
        .agg(F.min("parent").alias("parent"), F.min("place").alias("place"), F.min("ord").alias("ord"), F.max("w0").alias("w0"), F.max("w1").alias("w1"), F.max("tag").alias("tag"))
        .withColumns({"real": F.col("parent"), "step": F.lit(1).cast("long")}),
        "nodes",
    )
    if spread:
        rows = _spread(rows, keep)
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    crowded = rows.groupBy("place").count().where(F.col("count") > BUCKET_ROWS).select(F.col("place").alias("crowded"), F.ceil(F.col("count") / BUCKET_ROWS).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0))
    placed = rows.join(crowded, F.col("place").eqNullSafe(F.col("crowded")), "left").withColumn("bucket", F.pmod(F.xxhash64("place", part), F.lit(buckets)))
    placed = placed.drop("place", "crowded", "parts")
    return keep(placed.groupBy("bucket").applyInArrow(_contract, _LOCAL), "local")


def linked_tops(local: DataFrame, keep) -> DataFrame:
    """(origin, top, ext, next, step, ord, t0, t1) of the tops whose parent stands in another bucket; next is the parent's top, null
    where that is cyclic."""
    tops = local.where("node = top and ext is not null").select("origin", "top", "ext", "ord", "t0", "t1", F.col("step").alias("own"))
    targets = local.select("origin", F.col("node").alias("ext"), F.col("top").alias("next"), F.col("up").alias("above"), "cyclic")
    return keep(tops.join(targets, ["origin", "ext"]).withColumn("step", F.col("above") + F.col("own")).drop("above", "own"), "links")


def resolved(links: DataFrame, keep) -> DataFrame:
    """(origin, top, anc, dist, done): each linked top's root top and its distance; rows that are never done are cyclic.

    A round in which nothing more gets done proves that all the rest is cyclic: a node deeper than this round reaches has an
    ancestor that the round reaches first."""
    state = links.select("origin", "top", F.col("next").alias("anc"), F.col("step").alias("dist"), F.lit(False).alias("done"))
    waiting = state.count()
    while waiting:
        jump = state.select("origin", F.col("top").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"), F.lit(True).alias("on"))
        moved = state.where("not done and anc is not null").join(jump, ["origin", "anc"], "left")
        moved = moved.select(
            "origin",
            "top",
            F.when(F.col("on"), F.col("anc2")).otherwise(F.col("anc")).alias("anc"),
            (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"),
            (F.col("on").isNull() | F.col("done2")).alias("done"),
        )
        state = keep(state.where("done or anc is null").unionByName(moved), "doubled")
        left = state.where("not done and anc is not null").count()
        if left == waiting:
            break
        waiting = left
    return state


def hierarchy(nodes: DataFrame, keep) -> DataFrame:
    """(origin, node, parent, root, depth, missing): root null and depth -1 on cycles and below them; missing: the parent doesn't
    exist. nodes: (origin, node, parent, place, ord, w0, w1, tag); tag is passed on."""
    local = local_components(nodes, keep)
    return _rooted(local, resolved(linked_tops(local, keep), keep))


def _rooted(local: DataFrame, state: DataFrame) -> DataFrame:
    found = state.select("origin", "top", "anc", "dist", "done")
    rows = local.join(found, ["origin", "top"], "left")
    cyclic = F.col("cyclic") | (F.col("done").isNotNull() & ~F.col("done"))
    return rows.select(
        "origin", "node", "parent", "bucket", "ord", "w0", "w1", "tag", "real", "step", "top", "up", "ext",
        F.when(~cyclic, F.coalesce("anc", "top")).alias("root"),
        F.when(~cyclic, F.col("up") + F.coalesce("dist", F.lit(0))).otherwise(F.lit(-1)).alias("depth"),
        ((F.col("node") == F.col("top")) & F.col("ext").isNotNull() & F.col("done").isNull()).alias("missing"),
    )


def _order(bucket: pa.Table) -> pa.Table:
    """Within a bucket: what stands before each node below its local top, and below it; hung: tops of other buckets as children."""
    columns = {c: bucket[c].to_pylist() for c in bucket.column_names}
    hung = columns["hung"]
    at = {(o, x): i for i, (o, x, h) in enumerate(zip(columns["origin"], columns["node"], hung)) if not h}
    up = [-1 if p is None or (not h and t == x) else at.get((o, p), -1) for o, x, p, t, h in zip(columns["origin"], columns["node"], columns["parent"], columns["top"], hung)]
    n = len(up)
    kids: dict[int, list[int]] = {}
    for i, p in enumerate(up):
        if p >= 0:
            kids.setdefault(p, []).append(i)
    for own in kids.values():
        own.sort(key=lambda i: (columns["ord"][i] is None, columns["ord"][i] or 0, columns["node"][i]))
    w0, w1 = columns["w0"], columns["w1"]
    before, below0, below1 = [0] * n, [0] * n, [0] * n
    landmark, path = [None] * n, [None] * n
    for start in range(n):
        if up[start] >= 0 or hung[start]:
            continue
        order, todo = [], [start]
        while todo:
            x = todo.pop()
            order.append(x)
            todo.extend(reversed(kids.get(x, ())))
        for x in reversed(order):
            p = up[x]
            if p >= 0:
                below0[p] += w0[x] + below0[x]
                below1[p] += w1[x] + below1[x]
        count = 0
        for x in order:
            before[x] = count
            count += w0[x] + (below0[x] if hung[x] else 0)
            p = up[x]
            own = [columns["node"][x]] if columns["step"][x] else []
            if p < 0 or hung[x]:
                landmark[x], path[x] = columns["real"][x] if p < 0 else None, own
            elif own and len(path[p]) >= LANDMARK:
                landmark[x], path[x] = columns["node"][p] if columns["step"][p] else columns["real"][p], own
            else:
                landmark[x], path[x] = landmark[p], [*path[p], *own]
    columns |= {"before": before, "below0": below0, "below1": below1, "path_from": landmark, "path": path}
    names = [x.split()[0] for x in _ORDERED.split(", ")]
    return pa.table({c: pa.array(columns[c], _arrow(c)) for c in names})


_ORDERED = "origin string, node string, parent string, root string, depth long, missing boolean, top string, w0 long, w1 long, tag long, real string, step long, hung long, before long, below0 long, below1 long, path_from string, path array<string>"


def ordered_hierarchy(nodes: DataFrame, keep) -> DataFrame:
    """hierarchy() with each node's place in the walk of its tree, children by (ord, node).

    before: the sum of w0 of all nodes that come earlier in the walk from its root; below0, below1: the sums of w0 and w1 of its
    descendants (so with w0 = 1 the descendants of a node are those of its root with before in (before, before + below0]).
    path and path_from: the ids from below the ancestor path_from to the node; a node's full path is that of path_from and its path
    (a path written out for every node would be quadratic in the depth). Nodes without a root have null instead of these."""
    local = local_components(nodes, keep, spread=True)
    links = linked_tops(local, keep)
    state = resolved(links, keep)
    rows = _rooted(local, state)
    good = links.join(state.where("done").select("origin", "top"), ["origin", "top"], "left_semi")
    totals = keep(_tree_sums(good, local, keep), "totals")
    kids = good.join(totals, ["origin", "top"]).join(local.select("origin", F.col("node").alias("ext"), "bucket", F.col("top").alias("in_top")), ["origin", "ext"])
    hung = kids.select(
        "origin", F.col("top").alias("node"), F.col("ext").alias("parent"), "bucket", "ord", F.col("s0").alias("w0"), F.col("s1").alias("w1"), F.lit(0).cast("long").alias("tag"), F.col("in_top").alias("top"),
        F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(False).alias("missing"), F.lit(1).cast("long").alias("hung"),
        F.lit(None).cast("string").alias("real"), F.lit(1).cast("long").alias("step"),
    )
    inner = rows.where("root is not null").drop("up", "ext").withColumn("hung", F.lit(0).cast("long"))
    walked = keep(inner.unionByName(hung).groupBy("bucket").applyInArrow(_order, _ORDERED), "walked")
    starts = walked.where("hung = 1").select("origin", F.col("node").alias("top"), F.col("top").alias("next"), "before")
    base = _path_sums(starts, keep)
    numbered = walked.where("hung = 0").join(base, ["origin", "top"], "left").withColumn("before", F.col("before") + F.coalesce("base", F.lit(0))).drop("base", "hung", "top")
    rest = rows.where("root is null").select("origin", "node", "parent", "root", "depth", "missing", "w0", "w1", "tag", "real", "step")
    whole = numbered.unionByName(rest, allowMissingColumns=True)
    return whole.where("step = 1").withColumn("parent", F.col("real")).drop("real", "step")


def _tree_sums(good: DataFrame, local: DataFrame, keep) -> DataFrame:
    """(origin, top, s0, s1): the weights of all that hangs at each linked top, tops of other buckets included. Doubling: the sums
    within 2^k steps of a top are added to its ancestor 2^k steps up."""
    state = keep(good.select("origin", "top", F.col("next").alias("anc"), F.col("t0").alias("s0"), F.col("t1").alias("s1")), "sums")
    linked = state.select("origin", F.col("top").alias("anc"))
    state = keep(state.join(linked.withColumn("on", F.lit(True)), ["origin", "anc"], "left").withColumn("anc", F.when(F.col("on"), F.col("anc"))).drop("on"), "sums")
    while state.where("anc is not null").count():
        given = state.where("anc is not null").groupBy("origin", F.col("anc").alias("top")).agg(F.sum("s0").alias("g0"), F.sum("s1").alias("g1"))
        jump = state.select("origin", F.col("top").alias("anc"), F.col("anc").alias("anc2"))
        state = keep(
            state.join(given, ["origin", "top"], "left")
            .join(jump, ["origin", "anc"], "left")
            .select("origin", "top", F.col("anc2").alias("anc"), (F.col("s0") + F.coalesce("g0", F.lit(0))).alias("s0"), (F.col("s1") + F.coalesce("g1", F.lit(0))).alias("s1")),
            "sums",
        )
    return state.select("origin", "top", "s0", "s1")


def _path_sums(starts: DataFrame, keep) -> DataFrame:
    """(origin, top, base): what stands before each linked top in the walk from its root, by doubling along the contracted paths."""
    state = keep(starts.select("origin", "top", F.col("next").alias("anc"), F.col("before").alias("base")), "bases")
    while True:
        jump = state.select("origin", F.col("top").alias("anc"), F.col("anc").alias("anc2"), F.col("base").alias("base2"), F.lit(True).alias("on"))
        state = keep(
            state.join(jump, ["origin", "anc"], "left").select("origin", "top", F.col("anc2").alias("anc"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base")),
            "bases",
        )
        if not state.where("anc is not null").count():
            return state.select("origin", "top", "base")


def cycles(rows: DataFrame, keep) -> DataFrame:
    """(origin, cycle, node, parent, back_edge, length) of the nodes on cycles; a cycle is named by its least node, and its back edge is the one
    that leads to that node. rows: those of hierarchy().

    All nodes that have no root jump 2^k parents up at once, until one more doubling doesn't lessen the nodes that are landed on: on these
    the jump is a permutation, so they are the cycles. The least node of each is found by doubling along the cycles alone."""
    state = keep(rows.where("root is null").select("origin", "node", "parent", F.col("parent").alias("anc")), "unrooted")
    landed = state.select("origin", F.col("anc").alias("node")).distinct()
    before, now = None, landed.count()
    while now != before:
        jump = state.select("origin", F.col("node").alias("anc"), F.col("anc").alias("anc2"))
        state = keep(state.join(jump, ["origin", "anc"]).select("origin", "node", "parent", F.col("anc2").alias("anc")), "jumped")
        landed = state.select("origin", F.col("anc").alias("node")).distinct()
        before, now = now, landed.count()
    ring = keep(state.join(landed, ["origin", "node"], "left_semi").select("origin", "node", "parent", F.col("parent").alias("anc"), F.col("node").alias("least")), "rings")
    while now:
        ahead = ring.select("origin", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("least").alias("least2"))
        moved = ring.join(ahead, ["origin", "anc"]).select("origin", "node", "parent", F.col("anc2").alias("anc"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("changed"))
        moved = keep(moved, "rings")
        ring = moved.drop("changed")
        if not moved.where("changed").limit(1).count():
            break
    lengths = ring.groupBy("origin", "least").agg(F.count(F.lit(1)).alias("length"))
    return ring.join(lengths, ["origin", "least"]).select("origin", F.col("least").alias("cycle"), "node", "parent", (F.col("parent") == F.col("least")).alias("back_edge"), "length")


def _of_root(tree: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rooted nodes, and the wanted ones (origin, node) among them."""
    inner = tree.where("root is not null").select("origin", "root", "node", "depth", "before", "below0")
    chosen = inner.join(wanted.select("origin", "node").distinct(), ["origin", "node"], "left_semi")
    return inner, chosen.select("origin", "root", F.col("node").alias("of"), F.col("before").alias("of_before"), F.col("below0").alias("of_below"))


def path_of(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(origin, node, ancestor, depth): the full path of each wanted node (origin, node), one row for each node on it, itself included.

    tree: ordered_hierarchy() with w0 = 1. An ancestor is a node of the same root in whose interval the node lies."""
    inner, chosen = _of_root(tree, wanted)
    around = (F.col("of_before") >= F.col("before")) & (F.col("of_before") <= F.col("before") + F.col("below0"))
    return inner.join(chosen, ["origin", "root"]).where(around).select("origin", F.col("of").alias("node"), F.col("node").alias("ancestor"), "depth")


def descendants_of(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(origin, node, descendant, depth): all nodes below each wanted node (origin, node). tree: ordered_hierarchy() with w0 = 1."""
    inner, chosen = _of_root(tree, wanted)
    inside = (F.col("before") > F.col("of_before")) & (F.col("before") <= F.col("of_before") + F.col("of_below"))
    return inner.join(chosen, ["origin", "root"]).where(inside).select("origin", F.col("of").alias("node"), F.col("node").alias("descendant"), "depth")
