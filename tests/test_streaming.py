import os

from loomlog.streaming.follow import LineStreamReader, _mark, committed_end, follow


def rows(spark, target):
    return sorted((r.path.rsplit("/", 1)[-1], r.generation, r.byte_offset, bytes(r.line)) for r in spark.read.parquet(target).collect())


def test_appends_tails_and_rewrites(spark, tmp_path):
    root, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    (root / "deep").mkdir(parents=True)
    a, b = root / "a.jsonl", root / "deep" / "b.jsonl"
    a.write_bytes(b'{"n":1}\n{"n":2}\n{"n":')
    b.write_bytes(b"one\r\n\nthree\n")
    (root / "other.txt").write_bytes(b"no\n")
    follow(spark, str(root), target, checkpoint).awaitTermination(120)
    first = [("a.jsonl", 0, 0, b'{"n":1}'), ("a.jsonl", 0, 8, b'{"n":2}'), ("b.jsonl", 0, 0, b"one\r"), ("b.jsonl", 0, 5, b""), ("b.jsonl", 0, 6, b"three")]
    assert rows(spark, target) == first
    with a.open("ab") as f:
        f.write(b"3}\n")
    b.write_bytes(b"new\n")
    follow(spark, str(root), target, checkpoint).awaitTermination(120)
    assert rows(spark, target) == sorted([*first, ("a.jsonl", 0, 16, b'{"n":3}'), ("b.jsonl", 1, 0, b"new")])
    follow(spark, str(root), target, checkpoint).awaitTermination(120)
    assert len(rows(spark, target)) == 7


def test_committed_end(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"a\n" + b"x" * 200_000)
    assert committed_end(str(path), 200_002, 0) == 2 and committed_end(str(path), 200_002, 2) == 2 and committed_end(str(path), 0, 0) == 0


def test_rewrite_far_before_the_end(spark, tmp_path):
    root, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    root.mkdir()
    a = root / "a.jsonl"
    before = [b"token=Zanost4801"] + [b"line %05d" % i for i in range(2000)]
    a.write_bytes(b"\n".join(before) + b"\n")
    follow(spark, str(root), target, checkpoint).awaitTermination(120)
    with a.open("r+b") as f:  # redacted in place, in the same length
        f.write(b"token=xxxxxx0000")
    follow(spark, str(root), target, checkpoint).awaitTermination(120)
    got = rows(spark, target)
    assert [r[3] for r in got if r[1] == 0] == before
    assert [r[3] for r in got if r[1] == 1] == [b"token=xxxxxx0000", *before[1:]]


def test_the_running_stream_sees_rewrites_and_appends(tmp_path):
    a = tmp_path / "a.jsonl"
    a.write_bytes(b"secret\n" + b"x" * 9_000 + b"\n")
    os.utime(a, (1, 1))
    reader = LineStreamReader(str(tmp_path), ".jsonl", None)
    first = reader.latestOffset()
    assert reader.latestOffset() == first and first[str(a)][:2] == [9008, 0]
    with a.open("ab") as f:
        f.write(b"more\n")
    assert reader.latestOffset()[str(a)][:2] == [9013, 0]
    with a.open("r+b") as f:
        f.write(b"xxxxxx")
    os.utime(a, (1, 1))
    assert reader.latestOffset()[str(a)][:2] == [9013, 1]
    reader.known = {str(a): [9013, 1, _mark(str(a), 9013)]}  # of an older checkpoint
    reader.seen = {}
    assert reader.latestOffset()[str(a)][:2] == [9013, 1] and len(reader.known[str(a)][2]) == 64
