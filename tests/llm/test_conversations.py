import random

from loomlog.llm import conversations, queries
from loomlog.operators import forest
from loomlog.tables import stored, table

SCHEMA = "row_id long, session_id string, seq long, uuid string, parent_uuid string, msg_role string, content string, place string, origin string"


def brute(rows):
    sessions = {}
    for r in rows:
        if r[1] is not None and r[3] is not None:
            sessions.setdefault(r[1], {}).setdefault(r[3], r)
    spoken = {s: who for who, names in conversations.SPEAKERS.items() for s in names}
    who = lambda r: spoken.get((r[5] or "").strip().lower()) if r[6] and r[6].strip() else None
    found = []
    for session, own in sessions.items():
        roots = [r for r in own.values() if r[4] is None]
        if len(roots) != 1 or any(r[4] is not None and r[4] not in own for r in own.values()):
            continue
        order, todo = [], [roots[0]]
        while todo:
            x = todo.pop()
            order.append(x)
            todo += sorted((r for r in own.values() if r[4] == x[3]), key=lambda r: (r[2] is None, r[2] or 0, r[3]), reverse=True)
        if len(order) != len(own):
            continue
        below = {}
        for x in reversed(order):
            below[x[3]] = sum(below[r[3]] + (who(r) == "assistant") for r in own.values() if r[4] == x[3])
        users = [x for x in order if who(x) == "user"]
        if users and all(below[x[3]] for x in users):
            found += [(session, n + 1, x[3]) for n, x in enumerate(x for x in order if who(x))]
    return sorted(found)


def made(seed):
    r = random.Random(seed)
    rows, k = [], 0
    for s in range(60):
        n = r.randrange(1, 14)
        for i in range(n):
            parent = None if i == 0 else f"u{s}-{r.randrange(i) if r.random() < 0.3 else i - 1}"
            if r.random() < 0.02:
                parent = r.choice([None, "gone", f"u{s}-{n - 1}", f"u{s}-{i}", f"u{(s + 1) % 60}-0"])
            role = r.choice(["User", " human", "assistant", "MODEL ", "ai", "gemini", "tool", "toolResult", "system", None, "", "progress"]) if r.random() < 0.5 else ("user" if i % 2 == 0 else "assistant")
            row = (f"s{s}", i, None if r.random() < 0.01 else f"u{s}-{i}", parent, role, r.choice(["hi", "hi", "hi", "hi", None, "", " \n\t "]))
            for _ in range(1 + (r.random() < 0.1)):
                rows.append((k, *row, "x", "y"))
                k += 1
    rows.append((k, None, 0, "alone", None, "user", "x", "x", "y"))
    r.shuffle(rows)
    return rows


def test_turns_against_brute_force(spark, monkeypatch):
    for size, place in ((20_000, 4096), (11, 3)):
        monkeypatch.setattr(forest, "BUCKET_ROWS", size)
        monkeypatch.setattr(conversations, "PLACE_ROWS", place)
        rows = made(size)
        got = conversations.turns(spark.createDataFrame(rows, SCHEMA), stored)
        assert sorted((r.session_id, r.turn_no, r.uuid) for r in got.collect()) == brute(rows) != []


def test_turns_of_the_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, d, "chat_messages").select("row_id", "session_id", "seq", "uuid", "parent_uuid", "msg_role", "content").collect()]
    assert sorted(map(tuple, queries.p5_found(spark, d).collect())) == brute(rows)


def test_no_messages(spark):
    assert conversations.turns(spark.createDataFrame([], SCHEMA), stored).count() == 0


def test_clock_offsets(spark):
    late = 90_000_000  # the assistant's clock is ahead by so much
    replies = [("s", "assistant", "user", late + 2_000_000, 0), ("s", "user", "assistant", -late + 2_000_000, 0), ("s", "assistant", "user", late + 2_000_000, 0), ("s", "user", "assistant", -late + 2_000_000, 0), ("t", "user", "user", 5, 0), ("t", "user", "user", None, 0)]
    replies += [("u", "assistant", "user", -5, 0), ("u", "user", "assistant", 3, 0), ("v", "assistant", "user", -5, 0), ("v", "user", "assistant", 3, 2), ("w", "user", "user", -1, 0)]
    got = {(r.session_id, r.speaker): r for r in conversations.clock_offsets(spark.createDataFrame(replies, "session_id string, speaker string, to_speaker string, delay_us long, width_us long")).collect()}
    assert abs(got["s", "assistant"].offset_us - got["s", "user"].offset_us - late) < late * 0.02 and got["t", "assistant"].offset_us == 0 and len(got) == 20
    assert {s: got[s, "user"].feasible for s in "stuvw"} == {"s": True, "t": True, "u": False, "v": True, "w": False}
    assert got["v", "assistant"].offset_us - got["v", "user"].offset_us == -5


def brute_above(rows):
    own = {(r[1], r[3]): r for r in rows if r[1] is not None and r[3] is not None}
    spoken = {s for names in conversations.SPEAKERS.values() for s in names}
    turn = lambda r: (r[5] or "").strip().lower() in spoken and bool(r[6] and r[6].strip())
    found = set()
    for (session, uuid), r in own.items():
        at = own.get((session, r[4]))
        while at is not None and not turn(at):
            at = own.get((session, at[4]))
        if turn(r) and at is not None:
            found.add((session, uuid, at[3]))
    return found


def test_the_turn_above(spark):
    rows = made(3) + [(10_000 + i, "long", i, f"l{i}", f"l{i - 1}" if i else None, "user" if i in (0, 99) else None, "x", "", "") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = conversations.trees(df, stored)
    kept = {r.origin for r in nodes.groupBy("origin").count().collect()}
    cyclic = {(r.origin, r.node) for r in nodes.where("root is null").collect()}
    got = {tuple(r) for r in conversations.answered(nodes, stored).collect()}
    good = {r.session_id for r in conversations.turns_of(nodes).select("session_id").distinct().collect()} | {"long"}
    assert {x for x in got if x[0] in good} == {x for x in brute_above(rows) if x[0] in good and x[0] in kept and (x[0], x[1]) not in cyclic} and ("long", "l99", "l0") in got
    assert conversations.answered(nodes.where("false"), stored).count() == 0


def test_merge_by_corrected_clocks(spark):
    """The main chain and a side chain at once; the assistant's clock is ahead by half an hour, links stand between, one time is missing."""
    late, second = 1_800_000_000, 1_000_000
    rows, stamps, true = [], [], []

    def add(session, uuid, parent, role, at, width=0):
        rows.append((len(rows), session, len(rows), uuid, parent, role, "x" if role else None, "", ""))
        if role and at is not None:
            shown = at + (late if role == "assistant" else 0)
            stamps.append((session, uuid, shown - shown % width if width else shown, width))

    add("s", "m0", None, "user", 0)
    for i in range(1, 40):
        add("s", f"k{i}", f"m{i - 1}", None, None)
        add("s", f"m{i}", f"k{i}", "assistant" if i % 2 else "user", 10 * second * i + (i == 7), 0)
    add("s", "b0", "m0", "tool", 5 * second)
    for i in range(1, 38):
        add("s", f"b{i}", f"b{i - 1}", "assistant" if i % 2 else "tool", 5 * second + 10 * second * i)
    add("s", "end", "m39", "assistant", None)
    add("bad", "x0", None, "user", 100 * second)
    add("bad", "x1", "x0", "user", 0)  # a reply before what it answers, by one clock
    add("bad", "x2", "x1", "assistant", 200 * second)
    add("fine", "y0", None, "user", 100 * second)
    add("fine", "y1", "y0", "user", 125 * second, 60 * second)  # by the minute
    add("fine", "y2", "y1", "user", 130 * second)
    add("fine", "y3", "y2", "assistant", 200 * second)
    add("none", "z0", None, "user", None)
    add("none", "z1", "z0", "assistant", None)
    df, given = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(stamps, "session_id string, uuid string, instant_us long, width_us long")
    nodes = conversations.trees(df, stored)
    got = {(r.session_id, r.uuid): r for r in conversations.merged(conversations.turns_of(nodes), conversations.answered(nodes, stored), given, stored).collect()}
    assert len(got) == sum(r[5] is not None for r in rows)
    times = {f"m{i}": 10 * i for i in range(40)} | {f"b{i}": 5 + 10 * i for i in range(38)}
    want = [*sorted(times, key=times.get), "end"]
    assert sorted((r for k, r in got.items() if k[0] == "s"), key=lambda r: r.merged_no)[-1].uuid == "end"
    assert [r.uuid for r in sorted((r for k, r in got.items() if k[0] == "s"), key=lambda r: r.merged_no)] == want
    assert [r.turn_no for r in sorted((r for k, r in got.items() if k[0] == "s"), key=lambda r: r.merged_no)] != list(range(1, len(want) + 1))
    assert all(not r.feasible and r.merged_no is None for k, r in got.items() if k[0] == "bad")
    assert [got["fine", f"y{i}"].merged_no for i in range(4)] == [1, 2, 3, 4] and got["fine", "y0"].feasible
    assert [got["none", f"z{i}"].merged_no for i in range(2)] == [1, 2] and got["none", "z1"].corrected_us is None
    assert all(abs(r.residual_us) < 20 * second for k, r in got.items() if k[0] == "s" and r.residual_us is not None)
    empty = conversations.merged(conversations.turns_of(nodes).where("false"), conversations.answered(nodes, stored), given.where("false"), stored)
    assert empty.count() == 0


def test_precision(spark):
    from pyspark.sql import functions as F

    texts = {"2025-12-13 14:59": 60, "2025-12-13T14:59Z": 60, "20251213T1459": 60, "2025-12-13 14:59:10": 1, "20251213T225042Z": 1, "1765672374": 1, "2025-12-13T14:59:10.123Z": 0, "1765671357092": 0, "1.765667991415352E9": 0, "Dec 10, 2025 10:35:56 PM": 1, "2025-12-13T14:59:10+01:00": 1, "": 0}
    got = spark.createDataFrame([(x,) for x in texts], "raw string").select("raw", conversations.precision_us(F.col("raw")).alias("w")).collect()
    assert {r.raw: r.w // 1_000_000 for r in got} == texts
