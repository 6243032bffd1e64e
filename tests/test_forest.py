import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators import forest
from loomlog.tables import stored

SCHEMA = "origin string, node string, parent string, place string, ord long, w0 long, w1 long, tag long"


def brute(rows):
    parents, order = {}, {}
    for o, n, p, _, k, *_ in rows:
        if n is None:
            continue
        known = parents.get((o, n), "none yet")
        parents[o, n] = p if known == "none yet" or known is None else known if p is None else min(p, known)
        order[o, n] = k
    found = {}
    for key in parents:
        seen, at, depth = set(), key, 0
        while True:
            if at in seen:
                found[key] = (None, -1)
                break
            seen.add(at)
            up = (key[0], parents[at])
            if parents[at] is None or up not in parents:
                found[key] = (at[1], depth)
                break
            at, depth = up, depth + 1
    kids = {}
    for key, p in parents.items():
        kids.setdefault((key[0], p), []).append(key)
    for k in kids.values():
        k.sort(key=lambda x: (order[x] is None, order[x] or 0, x[1]))
    walk = {}
    for key in parents:
        if found[key] == (key[1], 0):
            todo, i, seq = [key], 0, []
            while todo:
                x = todo.pop()
                walk[x] = i
                i += 1
                seq.append(x)
                todo.extend(reversed(kids.get(x, [])))
            below = dict.fromkeys(seq, 0)
            for x in reversed(seq):
                up = (x[0], parents[x])
                if up in below and x != key:
                    below[up] += below[x] + 1
            for x in seq:
                walk[x] = (walk[x], below[x])
    return parents, found, walk


def shapes(seed):
    r = random.Random(seed)
    rows = []
    for i in range(400):
        p = r.choice([None, f"n{r.randrange(400)}", f"n{max(0, i - 1)}", f"n{r.randrange(max(1, i))}", "gone"])
        rows.append(("a", f"n{i}", p, str(i % 17), r.randrange(50), 1, 0, 0))
    for i in range(500):  # a chain
        rows.append(("b", f"c{i:03}", f"c{i - 1:03}" if i else None, str(i // 9), i, 1, 0, 0))
    rows += [("s", f"k{i:02}", "hub" if i % 3 else f"k{i - 1:02}", str(i % 5), r.randrange(9), 1, 0, 0) for i in range(1, 60)] + [("s", "hub", None, "0", 1, 1, 0, 0), ("s", "k00", "gone", "0", 1, 1, 0, 0)]  # a star with twigs
    rows += [("s", f"g{i}", "gone", "g", i, 1, 0, 0) for i in range(12)] + [("s", f"l{i}", "loop", "l", i, 1, 0, 0) for i in range(12)] + [("s", "loop", "l5", "l", 0, 1, 0, 0)]  # a crowd without its parent, and one on a cycle
    for i in range(30):  # a ring with a tail
        rows.append(("b", f"r{i}", f"r{(i + 1) % 20}" if i < 20 else f"r{i - 1}", str(i), i, 1, 0, 0))
    rows += [("b", "self", "self", "s", 1, 1, 0, 0), ("b", None, "c001", "s", 1, 1, 0, 0), ("b", "c003", "c002", "3", 3, 1, 0, 0), ("b", "", None, None, None, 1, 0, 0), ("a", "c001", "c000", "0", 1, 1, 0, 0)]
    return rows


@pytest.mark.parametrize("bucket_rows, most_children", [(7, 3), (20_000, 5_000)])
def test_against_brute_force(spark, monkeypatch, bucket_rows, most_children):
    monkeypatch.setattr(forest, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(forest, "CHILDREN", most_children)
    rows = shapes(1)
    parents, found, walk = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.origin, r.node): (r.root, r.depth) for r in forest.hierarchy(df, stored).collect()}
    assert got == found
    full = {(r.origin, r.node): r for r in forest.ordered_hierarchy(df, stored).collect()}
    assert {k: (r.root, r.depth) for k, r in full.items()} == found
    assert {k: (r.before, r.below0) for k, r in full.items() if r.root is not None} == walk
    for key, r in full.items():
        if r.root is None:
            continue
        steps, at = [], r
        while True:
            steps = [*at.path, *steps]
            if at.path_from is None or (key[0], at.path_from) not in full:
                break
            at = full[key[0], at.path_from]
        assert steps[0] == r.root and steps[-1] == r.node and len(steps) == r.depth + 1
        assert all(parents[key[0], b] == a for a, b in zip(steps, steps[1:]))


def test_empty(spark):
    assert forest.ordered_hierarchy(spark.createDataFrame([], SCHEMA), stored).count() == 0


def test_missing_parent_is_reported(spark):
    df = spark.createDataFrame([("a", "x", "gone", "p", 1, 1, 0, 0), ("a", "y", "x", "q", 1, 1, 0, 0)], SCHEMA)
    assert {(r.node, r.missing) for r in forest.hierarchy(df, stored).collect()} == {("x", True), ("y", False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_paths_and_descendants(spark, monkeypatch, seed):
    monkeypatch.setattr(forest, "BUCKET_ROWS", 50)
    rows = shapes(seed)
    parents, found, _ = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    rings = {}
    for key, (root, _) in found.items():
        if root is None:
            seen, at = [], key
            while at not in seen:
                seen.append(at)
                at = (key[0], parents[at])
            ring = seen[seen.index(at) :]
            if key in ring:
                rings[key] = (min(x[1] for x in ring), parents[key] == min(x[1] for x in ring), len(ring))
    tree = stored(forest.ordered_hierarchy(df, stored), "tree")
    got = forest.cycles(tree, stored).collect()
    assert {(r.origin, r.node): (r.cycle, r.back_edge, r.length) for r in got} == rings and len(got) == len(rings)
    assert sum(r.back_edge for r in got) == len({(r.origin, r.cycle) for r in got})
    assert forest.cycles(tree.where("root is not null"), stored).count() == 0
    paths = {}
    for key, (root, depth) in found.items():
        if root is not None:
            steps = [key]
            while steps[-1][1] != root:
                steps.append((key[0], parents[steps[-1]]))
            paths[key] = [x[1] for x in reversed(steps)]
    wanted = [("b", "c499"), ("s", "hub"), ("a", "n0"), ("a", "n5"), ("b", "r1"), ("b", "none"), ("b", "c100"), ("b", "c499")]
    asked = spark.createDataFrame(wanted, "origin string, node string")
    up = {}
    for r in forest.path_of(tree, asked).collect():
        up.setdefault((r.origin, r.node), []).append((r.depth, r.ancestor))
    assert {k: [x for _, x in sorted(v)] for k, v in up.items()} == {k: paths[k] for k in set(wanted) if k in paths}
    down = sorted((r.origin, r.node, r.descendant) for r in forest.descendants_of(tree, asked).collect())
    assert down == sorted((o, n, x[1]) for o, n in set(wanted) if (o, n) in paths for x, p in paths.items() if x[0] == o and n in p[:-1])
