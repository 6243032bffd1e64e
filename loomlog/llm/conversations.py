"""Conversations from message rows: whole trees of turns in order, and the clocks of their senders.

The order of a conversation is that of its tree. Beside it the turns are merged by time: from the delays of replies the clock offsets of a
session's senders are estimated by least squares, the constraint that a reply comes after what it answers (as far as their times are
written) is tested for all senders at once, and sessions without a negative cycle of these constraints get the turns of all branches in
the order of their corrected times. The others are rejected from the merge and flagged.

A session's rows are nodes of a tree by uuid and parent_uuid. Rows without uuid are ignored and repeated uuids count once. A session
is kept if its reply-before constraints are feasible and complete: one row without parent, every parent in the session, no
cycle, a user turn, and below each user turn an assistant turn. Null or blank contents and null or unknown roles are links of the
chain and no turns; a null session_id belongs to no conversation; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.tokenizers import STRIP
from loomlog.operators import forest, ordered

#: Speakers and the spellings of their roles: fixed values.
SPEAKERS = {
    "user": ["user", "human"],
    "assistant": ["assistant", "model", "gemini", "ai"],
    "tool": ["tool", "toolresult"],
    "system": ["system"],
}
_TAGS = {name: i + 1 for i, name in enumerate(SPEAKERS)}
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: So many messages that follow one another by seq are taken to lie close together in their tree.
PLACE_ROWS = 4096


def speaker(role: Column) -> Column:
    name = F.lower(F.btrim(role, F.lit(STRIP + "\x1c\x1d\x1e\x1f")))
    result = F.lit(None).cast("string")
    for who, spellings in SPEAKERS.items():
        result = F.when(name.isin(spellings), who).otherwise(result)
    return result


def nodes(messages: DataFrame) -> DataFrame:
    """The rows as nodes: w0 counts turns, w1 assistant turns; tag is the speaker of a turn, 0 of others."""
    who = F.when(F.col("content").rlike(rf"[^{_SPACE}]"), speaker(F.col("msg_role")))
    tag = F.lit(0).cast("long")
    for name, k in _TAGS.items():
        tag = F.when(who == name, F.lit(k).cast("long")).otherwise(tag)
    place = F.concat_ws("/", "session_id", F.coalesce(F.floor(F.col("seq") / PLACE_ROWS).cast("string"), F.col("uuid")))
    return (
        messages.where("session_id is not null and uuid is not null")
        .select(F.col("session_id").alias("origin"), F.col("uuid").alias("node"), F.col("parent_uuid").alias("parent"), place.alias("place"), F.col("seq").alias("ord"), tag.alias("tag"))
        .withColumns({"w0": (F.col("tag") > 0).cast("long"), "w1": (F.col("tag") == _TAGS["assistant"]).cast("long")})
    )


def kept_sessions(rows: DataFrame) -> DataFrame:
    user = F.col("tag") == _TAGS["user"]
    counts = rows.groupBy("origin").agg(
        F.count_if(F.col("parent").isNull()).alias("roots"),
        F.count_if("missing").alias("missing"),
        F.count_if(F.col("root").isNull()).alias("cyclic"),
        F.count_if(user).alias("users"),
        F.count_if(user & (F.coalesce("below1", F.lit(0)) == 0)).alias("unanswered"),
    )
    return counts.where("roots = 1 and missing = 0 and cyclic = 0 and users > 0 and unanswered = 0").select("origin")


def trees(messages: DataFrame, keep) -> DataFrame:
    """All rows of the messages as nodes in the order of their trees. A session is never gathered into one task: trees are walked in pieces
    (see forest)."""
    return keep(forest.ordered_hierarchy(nodes(messages), keep), "messages")


def turns_of(rows: DataFrame) -> DataFrame:
    """(session_id, turn_no, uuid, parent_uuid, speaker, depth) of the kept sessions' turns: parent before child, each branch to its
    end, siblings by seq."""
    names = F.create_map(*[F.lit(x) for name, k in _TAGS.items() for x in (k, name)])
    return (
        rows.where("w0 = 1")
        .join(kept_sessions(rows), "origin", "left_semi")
        .select(F.col("origin").alias("session_id"), (F.col("before") + 1).cast("long").alias("turn_no"), F.col("node").alias("uuid"), F.col("parent").alias("parent_uuid"), names[F.col("tag")].alias("speaker"), "depth")
    )


def turns(messages: DataFrame, keep) -> DataFrame:
    return turns_of(trees(messages, keep))


def answered(rows: DataFrame, keep) -> DataFrame:
    """(session_id, uuid, to_uuid): the nearest turn above each turn that has one; rows that are links of the chain only are jumped over, twice as
    many each round."""
    link = rows.where("w0 = 0 and root is not null").select("origin", "node", F.col("parent").alias("anc"))
    state = keep(link, "chain")
    while True:
        ahead = state.select("origin", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.lit(True).alias("on"))
        state = keep(state.join(ahead, ["origin", "anc"], "left").select("origin", "node", F.when(F.col("on"), F.col("anc2")).otherwise(F.col("anc")).alias("anc"), F.coalesce("on", F.lit(False)).alias("on")), "chain")
        if not state.where("on").limit(1).count():
            break
        state = state.drop("on")
    over = state.select("origin", F.col("node").alias("parent"), F.col("anc").alias("above"), F.lit(True).alias("jumped"))
    found = rows.where("w0 = 1 and parent is not null").select("origin", "node", "parent").join(over, ["origin", "parent"], "left")
    to = F.when(F.col("jumped"), F.col("above")).otherwise(F.col("parent"))
    return found.select(F.col("origin").alias("session_id"), F.col("node").alias("uuid"), to.alias("to_uuid")).where("to_uuid is not null")


def precision_us(raw: Column) -> Column:
    """How long the unit lasts in which a time is written: a minute, a second, or less (taken as nothing)."""
    bare = raw.rlike(r"\A\s*[+-]?[0-9]{10}(?:\.0*)?\s*\z")
    minutes = raw.rlike(r"[0-9]:[0-9]{2}(?![0-9:])") & ~raw.rlike(r"[0-9]:[0-9]{2}:[0-9]{2}") | raw.rlike(r"[0-9]{8}[Tt][0-9]{4}(?![0-9])")
    seconds = raw.rlike(r"[0-9]:[0-9]{2}:[0-9]{2}(?![0-9.,])") | raw.rlike(r"[0-9]{8}[Tt][0-9]{6}(?![0-9.,])")
    return F.when(minutes, 60_000_000).when(seconds | bare, 1_000_000).otherwise(0).cast("long")


def _solve(counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n, speakers) and gaps (n) from counts and summed delays (n, speakers, speakers) of replies by a to messages of b.

    Least squares of delay - (offset_a - offset_b) - gap over all replies; a weak pull to zero settles what no reply ties down."""
    n, k, _ = counts.shape
    normal, right = np.zeros((n, k + 1, k + 1)), np.zeros((n, k + 1))
    for a in range(k):
        for b in range(k):
            v = np.zeros(k + 1)
            v[a] += 1
            v[b] -= 1
            v[k] = 1
            normal += counts[:, a, b, None, None] * np.outer(v, v)
            right += sums[:, a, b, None] * v
    normal += np.diag([1e-2] * k + [1e-6])
    found = np.linalg.solve(normal, right[..., None])[..., 0]
    return found[:, :k], found[:, k]


def _feasible(least: np.ndarray) -> np.ndarray:
    """Whether offset_a - offset_b <= least (n, a, b) has a solution: no cycle of constraints is negative."""
    far = least.copy()
    for m in range(far.shape[1]):
        far = np.minimum(far, far[:, :, m, None] + far[:, None, m, :])
    return np.all(np.diagonal(far, axis1=1, axis2=2) >= 0, axis=1)


def _within(offsets: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Offsets that meet all constraints, from those given, lowered where one doesn't hold."""
    offsets = offsets.copy()
    for _ in range(offsets.shape[1]):
        offsets = np.minimum(offsets, np.min(offsets[:, None, :] + least, axis=2))
    return offsets


def clock_offsets(replies: DataFrame) -> DataFrame:
    """(session_id, speaker, offset_us, gap_us, feasible) from replies (session_id, speaker, to_speaker, delay_us, width_us).

    feasible: the constraints delay + width >= offset of the speaker - offset of the other have a solution; the offsets are one then."""
    order = list(SPEAKERS)
    pairs = [(a, b) for a in order for b in order]
    of = lambda a, b: (F.col("speaker") == a) & (F.col("to_speaker") == b)
    grouped = replies.where("delay_us is not null").groupBy("session_id").agg(
        *[F.count_if(of(a, b)).cast("double").alias(f"n{i}") for i, (a, b) in enumerate(pairs)],
        *[F.coalesce(F.sum(F.when(of(a, b), F.col("delay_us").cast("double"))), F.lit(0.0)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)],
        *[F.coalesce(F.min(F.when(of(a, b), (F.col("delay_us") + F.col("width_us")).cast("double"))), F.lit(1e18)).alias(f"m{i}") for i, (a, b) in enumerate(pairs)],
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(order)
            values = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).T.reshape(n, 3, k, k)
            offsets, gaps = _solve(values[:, 0], values[:, 1])
            fine = _feasible(values[:, 2])
            offsets = np.where(fine[:, None], _within(np.floor(offsets), values[:, 2]), np.floor(offsets))
            ids = batch.column(0).to_pylist()
            columns = [pa.array(np.repeat(x, k)) for x in (np.rint(gaps).astype("int64"), fine)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s in ids for _ in order], pa.string()), pa.array(order * n, pa.string()), pa.array(offsets.astype("int64").reshape(-1)), *columns], names=["session_id", "speaker", "offset_us", "gap_us", "feasible"]
            )

    return grouped.mapInArrow(run, "session_id string, speaker string, offset_us long, gap_us long, feasible boolean")


def _raised(timed: DataFrame, keep) -> DataFrame:
    """(session_id, uuid, floor_us) of the turns whose time lies before that of the turn they answer, or that have none: the time to which
    they are raised, as are those that answer them, as far as that goes."""
    above = timed.select("session_id", F.col("uuid").alias("to_uuid"), F.col("corrected_us").alias("floor_us"))
    found = []
    while True:
        late = timed.join(above, ["session_id", "to_uuid"]).where("floor_us is not null and (corrected_us is null or corrected_us < floor_us)")
        late = keep(late.select("session_id", "uuid", "floor_us"), "raised")
        if not late.limit(1).count():
            break
        found.append(late)
        above = late.withColumnRenamed("uuid", "to_uuid")
    whole = found[0] if found else late
    for x in found[1:]:
        whole = whole.unionByName(x)
    return whole.groupBy("session_id", "uuid").agg(F.max("floor_us").alias("floor_us"))


def merged(kept: DataFrame, above: DataFrame, stamps: DataFrame, keep) -> DataFrame:
    """The turns with their instants as written and corrected by their sender's clock, and merged_no, their place by corrected time, from 1.

    kept: turns_of(); above: answered(); stamps: (session_id, uuid, instant_us, width_us), of repeated ones the least. residual_us: what the delay of a
    reply differs from the estimate. A turn without a time goes with the turn it answers. merged_no is null where feasible isn't true; a
    session without timed replies has no constraints and is feasible."""
    once = stamps.groupBy("session_id", "uuid").agg(F.min_by(F.struct("instant_us", "width_us"), F.struct("instant_us", "width_us")).alias("s")).select("session_id", "uuid", "s.*")
    stamped = keep(kept.join(once, ["session_id", "uuid"], "left").join(above, ["session_id", "uuid"], "left"), "stamped")
    asked = stamped.select("session_id", F.col("uuid").alias("to_uuid"), F.col("speaker").alias("to_speaker"), F.col("instant_us").alias("asked_us"))
    replies = stamped.where("to_uuid is not null").join(asked, ["session_id", "to_uuid"]).select("session_id", "uuid", "speaker", "to_speaker", (F.col("instant_us") - F.col("asked_us")).alias("delay_us"), "width_us")
    replies = keep(replies, "replies")
    offsets = keep(clock_offsets(replies), "offsets")
    others = offsets.select("session_id", F.col("speaker").alias("to_speaker"), F.col("offset_us").alias("to_offset_us"))
    residuals = (
        replies.where("delay_us is not null").join(offsets, ["session_id", "speaker"]).join(others, ["session_id", "to_speaker"])
        .select("session_id", "uuid", (F.col("delay_us") - F.col("offset_us") + F.col("to_offset_us") - F.col("gap_us")).alias("residual_us"))
    )
    timed = stamped.join(offsets, ["session_id", "speaker"], "left").withColumn("corrected_us", F.col("instant_us") - F.coalesce("offset_us", F.lit(0))).withColumn("feasible", F.coalesce("feasible", F.lit(True)))
    timed = keep(timed.join(residuals, ["session_id", "uuid"], "left"), "timed")
    fine = timed.where("feasible")
    raised = fine.select("session_id", "uuid", "turn_no", "corrected_us").join(_raised(fine.select("session_id", "uuid", "to_uuid", "corrected_us"), keep), ["session_id", "uuid"], "left")
    when = F.greatest("corrected_us", "floor_us")
    numbers = ordered.numbered(keep(raised.select("session_id", "uuid", "turn_no", when.alias("at_us")), "at"), ["session_id"], [F.col("at_us").asc_nulls_first(), F.col("turn_no")], "n", keep)
    return timed.join(numbers.select("session_id", "uuid", (F.col("n") + 1).alias("merged_no")), ["session_id", "uuid"], "left").select(
        "session_id", "turn_no", "uuid", "speaker", "to_uuid", "instant_us", "offset_us", "corrected_us", "residual_us", "feasible", "merged_no"
    )
