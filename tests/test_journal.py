"""The journal's operators beside their SQL (see test_oracles) in the cases that the tables don't hold, and the ordered ones in small chunks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlog.functions import codec, text
from loomlog.operators import journal, ordered
from loomlog.sources import sqlite
from loomlog.tables import stored


@pytest.fixture
def rows(spark):
    r = random.Random(3)
    data = []
    for k in ("a", "b", None):
        for s in range(40 if k == "a" else 7):
            data.append((k, s, r.choice([None, "x", "y", "z"]), r.random() < 0.5))
    return spark.createDataFrame(data, "k string, s long, v string, f boolean")


def test_chunks_do_not_matter(rows, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 5)
    whole = Window.partitionBy("k").orderBy("s")
    past, future = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)
    want = rows.select("k", "s", F.last("v", True).over(past).alias("x"), F.first("v", True).over(future).alias("y"), F.coalesce(F.sum(F.col("f").cast("long")).over(past), F.lit(0)).alias("z"))
    got = ordered.count_before(ordered.next_after(ordered.last_before(rows, ["k"], "s", F.col("v"), "x"), ["k"], "s", F.col("v"), "y"), ["k"], "s", F.col("f"), "z")
    assert sorted(map(str, want.collect())) == sorted(map(str, got.select("k", "s", "x", "y", "z").collect()))


def test_numbers_over_ranges(rows):
    want = rows.select("k", "s", (F.row_number().over(Window.partitionBy("k").orderBy("v", "s")) - 1).cast("long").alias("n"))
    got = ordered.numbered(rows, ["k"], [F.col("v"), F.col("s")], "n", stored).select("k", "s", "n")
    assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
    assert ordered.numbered(rows.where("false"), ["k"], [F.col("s")], "n", stored).count() == 0


def test_lines_and_deltas(spark):
    texts = ["", "a", "a\n", "a\r\nb", "\n", "a\n\n", "a\rb", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", text.lines(F.col("t")).alias("l"))
    assert {r.t: r.l for r in df.collect()} == {"": [], "a": ["a"], "a\n": ["a"], "a\r\nb": ["a", "b"], "\n": [""], "a\n\n": ["a", ""], "a\rb": ["a\rb"], None: None}
    rows = [("a\n", "a\nb\n", "a\nb\n"), ("a\n", "b\n", "a\n"), ("a", "b\nc", "b"), ("a", "a", ""), ("", "", "")]
    df = spark.createDataFrame(rows, "b string, a string, f string")
    got = df.select(text.effect_present(F.col("b"), F.col("a"), F.col("f")).alias("p"), text.partial_effect(F.col("b"), F.col("a"), F.col("f")).alias("q"))
    assert [tuple(r) for r in got.collect()] == [(True, False), (False, False), (False, True), (True, False), (True, False)]


def test_paths_and_commands(spark):
    df = spark.createDataFrame([("\\w\\x\\a.py", "\\w\\x"), ("/w/x/a.py", "/w/x//"), ("/w/xa.py", "/w/x"), (None, "/w"), ("a", None)], "p string, c string")
    assert [r[0] for r in df.select(text.normalize_path("p" and F.col("p"), F.col("c"))).collect()] == ["/w/x/a.py", "a.py", "/w/xa.py", None, "a"]
    df = spark.createDataFrame([("echo x >> src/a",), ("cat 'b.rs'",), ("cargo x.rs",), ("ls",), ("",), ('echo > "',), (None,)], "c string")
    assert [r[0] for r in df.select(text.bash_target(F.col("c"))).collect()] == ["src/a", None, "x.rs", None, None, None, None]


def test_codec_boundary(spark):
    data = [b"x" * 1023, b"x" * 1024, bytes(random.Random(1).randbytes(2000)), b"", None]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(data)], "i int, p binary").withColumn("e", codec.encode("p"))
    got = {r.i: r for r in df.select("i", "e.*", codec.decode("e.payload", "e.codec").alias("d"), codec.decode_head(5)("e.payload", "e.codec").alias("h")).collect()}
    assert [got[i].codec for i in range(5)] == ["raw", "zstd", "raw", "raw", "raw"]
    assert all(got[i].d == data[i] and got[i].h == (None if data[i] is None else data[i][:5]) for i in range(5)) and got[1].payload_size == 1024
    plan = {r.i: r.action for r in df.select("i", codec.plan("p").alias("x")).select("i", "x.action").collect()}
    assert plan == {0: "small", 1: "compact", 2: "not_smaller", 3: "small", 4: "small"}
    broken = spark.createDataFrame([(bytearray(b"no zstd"), "zstd"), (bytearray(b"x"), "lz4")], "p binary, c string")
    assert [r[0] for r in broken.select(codec.decode_head(5)("p", "c")).collect()] == [None, None]
    with pytest.raises(Exception, match="unsupported codec"):
        journal.guarded(broken.withColumnRenamed("c", "codec")).collect()


def test_import_modes(spark):
    cases = [  # size, stored, same, jsonl, intact, retry, offset
        ((5, 5, True, True, True, False, 5), "skip"), ((5, None, None, True, True, False, 0), "append"), ((9, 5, False, True, False, False, 5), "rewrite"), ((9, 5, False, True, True, False, 5), "append"),
        ((5, 5, False, True, True, True, 3), "append"), ((5, 5, False, True, True, False, 3), "rewrite"), ((9, 5, False, False, True, False, 5), "rewrite"), ((2, 5, False, True, True, True, 3), "rewrite"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "a long, b long, c boolean, d boolean, e boolean, f boolean, g long")
    assert [r[0] for r in df.select(journal.import_mode(*[F.col(c) for c in "abcdefg"])).collect()] == [w for _, w in cases]


ERRORS = "source string, source_session_id string, file_path string, generation long, byte_offset long, line_number long, error_kind string, message string, first_seen_at string, last_seen_at string, occurrence_count long"


def test_errors_meet_again(spark):
    key = ("s", None, "/p", None, 3, 4, "invalid_json")
    old = spark.createDataFrame([(*key, "old", "1", "1", 2), ("s", "x", "/q", 0, 1, 1, "read_error", "m", "1", "1", 1)], ERRORS)
    new = spark.createDataFrame([(*key, "new", "5", "5", 1), ("s", None, "/r", None, None, None, "not_file", "m", "5", "5", 1)], ERRORS)
    got = {r.file_path: (r.message, r.first_seen_at, r.last_seen_at, r.occurrence_count) for r in journal.upsert_errors(old, new).collect()}
    assert got == {"/p": ("new", "1", "5", 3), "/q": ("m", "1", "1", 1), "/r": ("m", "5", "5", 1)}
    rows = journal.upsert_errors(old, new).withColumns({"resolved_at": F.lit(None).cast("string"), "resolution_note": F.lit(None).cast("string")})
    fixed = spark.createDataFrame([("s", "/p", "invalid_json")], "source string, file_path string, error_kind string")
    assert {r.file_path: r.resolved_at for r in journal.resolve_errors(rows, fixed, F.lit("9"), "n").collect()} == {"/p": "9", "/q": None, "/r": None}


def test_pages_and_limits(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "a long, b long")
    assert journal.page(df, [F.col("a")], 50).count() == 51 and journal.page(df, [F.col("a")], 50, 50).count() == 10
    assert journal.checked_offset(100_001) == 0 and journal.checked_offset(100_000) == 100_000 and journal.checked_offset(-1) == 0
    for wrong in (0, -1):
        with pytest.raises(ValueError):
            journal.checked_limit(wrong)
    with pytest.raises(ValueError):
        journal.after(df, ["a"], (1,), 10_001)
    assert [r.a for r in journal.after(df.select(F.col("a").cast("long")), ["a"], (57,)).collect()] == [58, 59]
    assert journal.nth(df, ["a"], 61).count() == 0


def test_searches(spark):
    s = spark.createDataFrame([(1, "claude_cli", "a%b", "/w", None, None, "2", "2", 1), (2, "hermes", "axb", None, "/f", 1, None, "3", 1)], "session_id long, source string, source_session_id string, cwd string, file_path string, parent_session_id long, started_at string, updated_at string, event_count long")
    ids = lambda **k: [r.session_id for r in journal.sessions_page(s, **k).collect()]
    assert ids() == [2, 1] and ids(search="%") == [1] and ids(search="a_b") == [] and ids(search="E_CL") == [1] and ids(search="zzz", hits=spark.createDataFrame([(2,), (2,)], "session_id long")) == [2]
    heads = spark.createDataFrame([(1, bytearray(b"\xffNeedle")), (2, None)], "session_id long, head binary")
    assert [r[0] for r in journal.payload_hits(heads, "needle").collect()] == [1] and journal.payload_hits(heads, "ne").count() == 0
    first = journal.sessions_page(s)
    assert journal.selected(first, s, 1).session_id == 1 and journal.selected(first, s, 99).session_id == 2 and journal.selected(first.where("false"), s, None) is None
    events = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, 0, 0), (2, 0, 0)], "session_id long, generation long, seq long")
    assert [tuple(r)[1:] for r in journal.session_events(events, s, "claude_cli", "a%b", 2).collect()] == [(0, 0), (0, 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], ERRORS).withColumns({"resolved_at": F.lit(None).cast("string"), "id": F.lit(1)})
    assert journal.status(none, none, journal.unresolved(none)).first() == (0, 0, 0) and journal.doctor(none)[0].first()[0] == 0 and journal.doctor(none)[1] is None
    events = spark.createDataFrame([], "payload binary, codec string")
    assert tuple(journal.codec_stats(events).first()) == (0, 0, 0, 0, 0)


def test_sqlite_ranges(spark, tmp_path, monkeypatch):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (id text, p text)")
        c.executemany("insert into t values (?, ?)", [(str(i), None) for i in range(25)])
    reader = sqlite.TableReader(spark.createDataFrame([], "id string, p string").schema, {"path": path, "table": "t"})
    monkeypatch.setattr(sqlite, "ROWS_PER_PARTITION", 10)
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(list(reader.read(p))) for p in parts) == 25
    assert sqlite.discover(spark, path, "s", "t", "p").count() == 25
    assert sqlite.discover(spark, str(tmp_path / "none.db"), "s", "t", "p").count() == 0
    (tmp_path / "bad.db").write_bytes(b"no database at all, but long enough to be read as one" * 9)
    assert [r.id_kind for r in sqlite.discover(spark, str(tmp_path / "bad.db"), "s", "t", "p").collect()] == ["store_error"]
    with sqlite3.connect(path) as c:
        c.execute("insert into t values (' ', null)")
    assert sqlite.discover(spark, path, "s", "t", "p").count() == 1


def test_pruned_columns(spark):
    """A page of events doesn't read payloads."""
    from loomlog.plans import journal as queries

    plan = queries.QUERIES["generation_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    schema = plan.rsplit("ReadSchema:", 1)[1].split("\n")[0]
    assert "raw_line" not in schema and "file_id" in schema


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    """A page reads no payload, a batch's first key reaches the scan, and a retention gathers no more than it keeps."""
    from loomlog.plans import journal as queries

    d = "/root/testdata/sf0.001"
    page = plan_of(queries.QUERIES["events_page"](spark, d))
    assert all("raw_line" not in x.split("\n")[0] for x in page.split("ReadSchema:")[1:])
    batch = plan_of(queries.QUERIES["keyset_batch"](spark, d))
    assert "GreaterThanOrEqual(file_id,100)" in batch.rsplit("PushedFilters:", 1)[1].split("\n")[0]
    assert "CollectLimit" not in plan_of(queries.QUERIES["retention"](spark, d))
    before = plan_of(queries.QUERIES["trigger_asof"](spark, d))
    assert "content" not in before.rsplit("ReadSchema:", 1)[1].split("\n")[0]


def test_retention(spark):
    df = spark.createDataFrame([("b",), ("d",), (None,), ("a",), ("c",), ("c",)], "name string")
    names = lambda keep: sorted((r.name for r in journal.beyond_newest(df, "name", keep).collect()), key=str)
    assert names(0) == sorted(["a", "b", "c", "c", "d", None], key=str) and names(1) == sorted(["a", "b", "c", "c", None], key=str) and names(2) == sorted(["a", "b", None], key=str) == names(3)
    assert names(5) == [None] == names(9) and journal.beyond_newest(df.where("false"), "name", 3).count() == 0


def test_values_before(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 7)
    df = spark.createDataFrame([(k, i, None if i % 4 == 0 else f"{k}{i}") for k in ("a", "b") for i in range(30 if k == "a" else 3)], "k string, s long, v string")
    got = {(r.k, r.s): r.x for r in ordered.values_before(df, ["k"], "s", F.col("v"), 5, "x").collect()}
    assert got == {(k, i): [None if j % 4 == 0 else f"{k}{j}" for j in range(max(0, i - 5), i)] for k, n in (("a", 30), ("b", 3)) for i in range(n)}
    assert ordered.values_before(df.where("false"), ["k"], "s", F.col("v"), 5, "x").count() == 0
