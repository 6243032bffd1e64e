"""Mixing sources to target weights by pivotal dependent rounding.

A mix wants total_ratio times the tokens of all documents, and target_share of that from each named source. A source's documents
are each used goal / available times, max_repeat at most; where that cap binds, or a source has no documents, the mix stays
smaller and the report shows it. The whole part of the uses is given to every document; the fractional parts are rounded in
pairs: mass moves at random from one document to another, their tokens together unchanged and each one's expectation kept, until
one of the two is whole.

Each task leaves one document undecided for each mix and source, and RESERVE more that it doesn't touch; these residuals are combined the
same way through a tree of tasks. At its root the last ones are rounded, too, and what then lacks or is too much is settled by using others of
them, as a subset sum: the expectations of those few are not kept, but a source misses its goal by a token instead of by a document.

Documents without source, of no tokens, or of a source that no mix names aren't used. The rows are put in tasks and in order by the
hash of their id, so the result depends on the seed, the ids and the sizes alone, not on how the table is stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 16
#: So many documents of each mix and source, drawn by the hash of their ids, stay undecided up to the root.
RESERVE = 64
#: So many documents are rounded by one task.
TASK_ROWS = 20_000
_TINY = 1e-9
_ROUNDED = "mix_name string, source string, doc_id long, n_tokens long, whole long, p double, leaf long"


@dataclass(frozen=True)
class Cell:
    """What one source has to give to one mix."""

    mix_name: str
    source: str
    target_share: float
    goal: float
    available: int
    uses: float


def cells(targets: list, available: dict[str, int], total: int) -> list[Cell]:
    found = []
    for t in targets:
        goal, there = t["target_share"] * t["total_ratio"] * total, available.get(t["source"], 0)
        uses = min(float(t["max_repeat"]), goal / there) if there else 0.0
        found.append(Cell(t["mix_name"], t["source"], t["target_share"], goal, there, max(0.0, uses)))
    return found


def _draw(*parts) -> float:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big") / 2**64


class _Pivot:
    """Rounds the documents of one mix and source that come one after another; the first RESERVE aren't touched, rest is the undecided one."""

    def __init__(self, key: tuple, reserve: int = 0):
        self.key, self.reserve, self.kept, self.rest, self.done = key, reserve, [], None, []

    def add(self, doc: int, weight: int, whole: int, p: float) -> None:
        if p <= _TINY or p >= 1 - _TINY:
            self.done.append((doc, weight, whole, float(round(p))))
            return
        if len(self.kept) < self.reserve:
            self.kept.append((doc, weight, whole, p))
            return
        if self.rest is None:
            self.rest = (doc, weight, whole, p)
            return
        a, wa, ka, pa_ = self.rest
        scale = wa / weight
        up, down = min(1 - pa_, p / scale), min(pa_, (1 - p) / scale)  # how far the first can rise or fall
        move = up if _draw(*self.key, a, doc) < down / (up + down) else -down
        first, second = pa_ + move, p - move * scale
        self.rest = None
        for each in ((a, wa, ka, first), (doc, weight, whole, second)):
            if each[3] <= _TINY or each[3] >= 1 - _TINY:
                self.done.append((*each[:3], float(round(each[3]))))
            else:
                self.rest = each

    def open(self) -> list[tuple]:
        """The undecided documents."""
        return [*self.kept, *([self.rest] if self.rest else [])]


def nearest(changes: list[int], goal: float) -> list[int]:
    """Which of the changes, taken together, sum to what is nearest to the goal: an exact subset sum in steps of one, or of a two-millionth of
    what all of them could change. The first changes are preferred."""
    step = max(1, sum(map(abs, changes)) // 2_000_000)
    changes = [round(x / step) for x in changes]
    zero = -sum(x for x in changes if x < 0)
    at = min(max(zero + round(goal / step), 0), zero + sum(x for x in changes if x > 0))
    layers = [1 << zero]
    for x in changes:
        layers.append(layers[-1] | (layers[-1] << x if x >= 0 else layers[-1] >> -x))
        if layers[-1] >> at & 1:
            break
    above, below = layers[-1] >> at, layers[-1] & ((1 << at) - 1)
    up = (above & -above).bit_length() - 1 if above else None
    down = at - below.bit_length() + 1 if below else None
    at += up if down is None or up is not None and up <= down else -down
    found = []
    for k in range(len(layers) - 1, 0, -1):
        if not layers[k - 1] >> at & 1:
            found.append(k - 1)
            at -= changes[k - 1]
    return found


def settled(key: tuple, rows: list[tuple]) -> list[tuple]:
    """The last undecided documents (doc, tokens, whole, p) with p 0 or 1, rounded in pairs and then changed where that brings their tokens
    nearer to the sum of p * tokens."""
    pivot = _Pivot(key)
    for row in rows:
        pivot.add(*row)
    chosen = [[*row] for row in pivot.done]
    if pivot.rest:
        chosen.append([*pivot.rest[:3], float(_draw(*key, pivot.rest[0]) < pivot.rest[3])])
    lacking = sum(w * p for _, w, _, p in rows) - sum(w * p for _, w, _, p in chosen)
    for i in nearest([-w if p else w for _, w, _, p in chosen], lacking) if abs(lacking) >= 0.5 else ():
        chosen[i][3] = 1.0 - chosen[i][3]
    return [tuple(row) for row in chosen]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[]] * 7
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _ROUNDED.split(", ")])


def _rows(pivots: dict[tuple, _Pivot], leaf: int, last: bool) -> pa.RecordBatch:
    """Decided documents have leaf -1; the residuals carry the task's number."""
    out: list[tuple] = []
    for (mix, source), pivot in pivots.items():
        out += [(mix, source, d, w, k, p, -1) for d, w, k, p in pivot.done]
        pivot.done = []
        if last:
            out += [(mix, source, *row, leaf) for row in pivot.open()]
    return _batch(out)


def mix(sizes: DataFrame, targets: DataFrame, keep, seed: int = 42) -> tuple[DataFrame, list[Cell]]:
    """(mix_name, source, doc_id, n_tokens, uses) of the used documents, and the cells.

    sizes: (doc_id, source, n_tokens), stored, as it is read twice. targets is a fixed table, read to the driver with one sum of tokens for
    each source that it names."""
    wanted = targets.where("mix_name is not null and source is not null").orderBy("mix_name", "source").collect()
    named = sorted({t["source"] for t in wanted})
    sums = sizes.groupBy(F.when(F.col("source").isin(named), F.col("source")).alias("source")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    total = sum(r["n"] or 0 for r in sums)
    found = cells(wanted, {r["source"]: r["n"] or 0 for r in sums if r["source"] is not None}, total)
    by_source: dict[str, list[tuple[str, int, float]]] = {}
    for c in found:
        by_source.setdefault(c.source, []).append((c.mix_name, int(c.uses), c.uses - int(c.uses)))

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[tuple, _Pivot] = {}
        leaf = TaskContext.get().partitionId()
        for batch in batches:
            for doc, source, n in zip(*(c.to_pylist() for c in batch.columns)):
                for name, whole, p in by_source.get(source, ()) if n else ():
                    key = (name, source)
                    if key not in pivots:
                        pivots[key] = _Pivot((seed, *key), RESERVE)
                    pivots[key].add(doc, n, whole, p)
            yield _rows(pivots, leaf, False)
        yield _rows(pivots, leaf, True)

    def in_order(group: pa.Table) -> list[dict]:
        return sorted(group.to_pylist(), key=lambda r: (_draw(seed, r["doc_id"]), r["doc_id"]))

    def combine(group: pa.Table) -> pa.Table:
        pivots: dict[tuple, _Pivot] = {}
        rows = in_order(group)
        for r in rows:
            key = (r["mix_name"], r["source"])
            pivots.setdefault(key, _Pivot((seed, *key), RESERVE)).add(r["doc_id"], r["n_tokens"], r["whole"], r["p"])
        return pa.Table.from_batches([_rows(pivots, rows[0]["leaf"] // FAN_IN, True)])

    def settle(group: pa.Table) -> pa.Table:
        rows = in_order(group)
        key = (rows[0]["mix_name"], rows[0]["source"])
        return pa.Table.from_batches([_batch([(*key, *row, -1) for row in settled((seed, *key), [(r["doc_id"], r["n_tokens"], r["whole"], r["p"]) for r in rows])])])

    width = max(1, -(-sum(r["rows"] for r in sums if r["source"] is not None) // TASK_ROWS))
    used = sizes.select("doc_id", "source", "n_tokens").where(F.col("source").isin(named) & (F.col("n_tokens") > 0))
    placed = used.repartition(width, F.xxhash64(F.lit(seed), "doc_id")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "source", "n_tokens")
    level = keep(placed.mapInArrow(leaves, _ROUNDED), "leaves")
    decided = level.where("leaf = -1")
    level = level.where("leaf >= 0")
    while width > 1:
        level = keep(level.groupBy("mix_name", "source", F.floor(F.col("leaf") / FAN_IN).alias("branch")).applyInArrow(combine, _ROUNDED), "branches")
        decided = decided.unionByName(level.where("leaf = -1"))
        level = level.where("leaf >= 0")
        width = -(-width // FAN_IN)
    last = keep(level.groupBy("mix_name", "source").applyInArrow(settle, _ROUNDED), "settled")
    uses = (F.col("whole") + F.col("p").cast("long")).alias("uses")
    return decided.unionByName(last).select("mix_name", "source", "doc_id", "n_tokens", uses).where("uses > 0"), found


def shares(mixed: DataFrame, found: list[Cell]) -> DataFrame:
    """(mix_name, source, target_share, goal_tokens, available_tokens, used_tokens, uses, goal_share, actual_share, bound) of every target.

    goal_share: the used tokens as a share of what the mix wants; actual_share: of what it has. bound says why a goal isn't met: `documents`
    (there are none), `max_repeat`, or null."""
    spark = mixed.sparkSession
    rows = [(c.mix_name, c.source, c.target_share, c.goal, c.available, "documents" if c.goal > 0 and not c.available else "max_repeat" if c.uses * c.available < c.goal - 1e-6 * (1 + c.goal) else None) for c in found]
    plan = spark.createDataFrame(rows, "mix_name string, source string, target_share double, goal_tokens double, available_tokens long, bound string")
    used = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.sum("uses").alias("uses"))
    whole = used.groupBy("mix_name").agg(F.sum("used_tokens").alias("all_tokens"))
    tokens, share = F.coalesce("used_tokens", F.lit(0)), F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0))
    return (
        plan.join(used, ["mix_name", "source"], "left")
        .join(whole, "mix_name", "left")
        .select(
            "mix_name", "source", "target_share", "goal_tokens", "available_tokens", tokens.alias("used_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"),
            F.when(F.col("goal_tokens") > 0, tokens * F.col("target_share") / F.col("goal_tokens")).otherwise(F.lit(0.0)).alias("goal_share"), share.alias("actual_share"), "bound",
        )
    )
