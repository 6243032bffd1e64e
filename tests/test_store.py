"""The journal's store: its lock, compaction by folder, archives, and the commands over it."""

import io
import json
import os
import socket
import subprocess
import tarfile

import pytest

from loomlog import __main__ as command
from loomlog.functions import text
from loomlog.operators import journal
from loomlog.plans import ingest, transfer
from loomlog.plans import store as stores
from loomlog.plans.store import Store

SESSION = {"session_id": 1, "source": "claude_cli", "source_session_id": "a", "file_path": "/f", "current_generation": 0, "event_count": 3}
BIG, SMALL = b'{"text": "' + b"word " * 600 + b'"}', b'{"a": 1}'


def filled(spark, root, payloads):
    """A journal of one session, with one folder of events for each list of payloads."""
    store = Store(spark, str(root))
    names = [x.strip().split()[0] for x in stores.SCHEMAS["sessions"].split(",")]
    store.commit(sessions=spark.createDataFrame([tuple(SESSION.get(n) for n in names)], stores.SCHEMAS["sessions"]))
    for g, own in enumerate(payloads):
        store.commit(events=spark.createDataFrame([(1, g, i, None, p, "raw", len(p), None) for i, p in enumerate(own)], stores.SCHEMAS["events"]))
    return store


def test_lock(spark, tmp_path, monkeypatch):
    store, lock = filled(spark, tmp_path / "j", [[SMALL]]), tmp_path / "j" / "journal.lock"
    with store.writing():
        assert json.loads(lock.read_text())["pid"] == os.getpid()
        with pytest.raises(RuntimeError, match=f"process {os.getpid()}"):
            with store.writing():
                pass
    assert not lock.exists()
    gone = subprocess.Popen(["true"])
    gone.wait()
    left = [{"host": socket.gethostname(), "pid": gone.pid}, {"host": "elsewhere", "pid": 1}]
    for owner, age in zip(left, (0, stores.STALE + 60)):  # one that has ended here, and one elsewhere that touches nothing any more
        store._write("journal.lock", json.dumps(owner), True)
        store._fs.setTimes(store._path(f"{store.root}/journal.lock"), int((stores.time.time() - age) * 1000), -1)
        with store.writing():
            assert json.loads(lock.read_text())["pid"] == os.getpid()
        assert not lock.exists()
    store._write("journal.lock", json.dumps(left[1]), True)
    with pytest.raises(RuntimeError, match="elsewhere"):
        with store.writing():
            pass
    os.remove(lock)
    monkeypatch.setattr(stores, "BEAT", 0.05)
    with store.writing():  # touched while it is held
        store._fs.setTimes(store._path(f"{store.root}/journal.lock"), 1000, -1)
        stores.time.sleep(0.5)
        assert os.path.getmtime(lock) > 1e9


def test_compaction_by_folder(spark, tmp_path):
    store = filled(spark, tmp_path / "j", [[SMALL, SMALL], [BIG, SMALL, BIG], [SMALL]])
    before = store.state()["tables"]["events"]
    assert ingest.compact(store) == {"compact": 2, "small": 4, "not_smaller": 0, "round_trip_failed": 0, "saved_bytes": ingest.compact(store)["saved_bytes"]} and store.state()["tables"]["events"] == before
    assert ingest.compact(store, apply=True)["compact"] == 2
    after = store.state()["tables"]["events"]
    assert [f in after for f in before] == [True, False, True] and len(after) == 3
    rows = store.table("events").select("generation", "seq", "codec", ingest.codec.decode("payload", "codec").alias("p"), "payload_size").collect()
    assert sorted((r.generation, r.seq, r.codec, bytes(r.p), r.payload_size) for r in rows) == sorted((g, i, "zstd" if p is BIG else "raw", p, len(p)) for g, own in enumerate([[SMALL, SMALL], [BIG, SMALL, BIG], [SMALL]]) for i, p in enumerate(own))
    assert ingest.compact(store, apply=True)["compact"] == 0 and store.state()["tables"]["events"] == after and store.check() == []
    assert store.reclaimable() > 0 and store.vacuum() == [before[1]] and store.reclaimable() == 0
    with store.writing(), pytest.raises(RuntimeError):  # not while another run writes
        ingest.compact(store, apply=True)
    assert ingest.compact(Store(spark, str(tmp_path / "none")), apply=True)["compact"] == 0


def test_archive(spark, tmp_path):
    store, archive = filled(spark, tmp_path / "j", [[SMALL], [BIG]]), str(tmp_path / "a.tar.gz")
    with store.writing():
        assert transfer.pack(store, archive) == {"sessions": 1, "events": 2}
    assert os.stat(archive).st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        transfer.pack(store, archive)
    root = str(tmp_path / "other")
    assert transfer.settle(spark, archive, root) == {"sessions": 1, "events": 2} and not os.path.exists(f"{root}/journal.lock")
    with pytest.raises(FileExistsError):
        transfer.settle(spark, archive, root)
    filled(spark, root, [[SMALL]] * 3)
    assert transfer.settle(spark, archive, root, force=True) == {"sessions": 1, "events": 2} and Store(spark, root).check() == []
    assert transfer.default_name(0) == "journal-pack-19700101-000000Z.tar.gz"


@pytest.mark.parametrize("name, kind", [("/etc/x", tarfile.REGTYPE), ("../x", tarfile.REGTYPE), ("data/../../x", tarfile.REGTYPE), ("data/events-1/x", tarfile.SYMTYPE), ("data/events-1/x", tarfile.LNKTYPE), ("data/events-1/x", tarfile.FIFOTYPE), ("journal.lock", tarfile.REGTYPE), ("data/other-1/x", tarfile.REGTYPE)])
def test_archives_that_are_refused(spark, tmp_path, name, kind):
    archive = str(tmp_path / "bad.tar.gz")
    with tarfile.open(archive, "w:gz") as out:
        head = tarfile.TarInfo("journal.json")
        head.size = 2
        out.addfile(head, io.BytesIO(b"{}"))
        bad = tarfile.TarInfo(name)
        bad.type, bad.linkname = kind, "/etc/passwd"
        out.addfile(bad)
    store = filled(spark, tmp_path / "j", [[SMALL]])
    with pytest.raises(ValueError):
        transfer.settle(spark, archive, str(tmp_path / "j"), force=True)
    assert store.table("events").count() == 1


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    root = str(tmp_path / "j")
    filled(spark, root, [[SMALL], [BIG]])

    def run(*given):
        code = command.main(["--journal", root, *given])
        shown = capsys.readouterr()
        return code, [json.loads(x) for x in shown.out.splitlines() if x.startswith("{")], shown.err

    assert run("status")[1][0] | {"stored_bytes": 0} == {"sessions": 1, "events": 2, "errors": 0, "raw_events": 2, "zstd_events": 0, "unsupported_events": 0, "small_events": 1, "stored_bytes": 0}
    assert run("doctor")[1] == [{"unresolved": 0}] and run("doctor", "--details", "5")[1] == []
    assert [r["source_session_id"] for r in run("sessions")[1]] == ["a"] and run("sessions", "--search", "none")[1] == []
    assert run("compact")[1][0]["compact"] == 1 and run("compact", "--apply")[1][0]["compact"] == 1 and len(run("vacuum")[1][0]["folders"]) == 1
    assert run("pack", "--output", "x.tar.gz")[1][0]["events"] == 2 and run("pack")[1][0]["archive"].startswith("journal-pack-")
    code, _, error = run("settle", "x.tar.gz")
    assert code == 1 and "holds a journal" in error and run("settle", "x.tar.gz", "--force")[1] == [{"sessions": 1, "events": 2}]
    assert run("events", "claude_cli", "a", f"{tmp_path}/out")[0] == 0 and run("events", "claude_cli", "b", f"{tmp_path}/out2")[0] == 1
    assert sorted(len(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()) == sorted([len(SMALL), len(BIG)])
    code, _, error = run("extract", "--history", "none", "--session", "claude_cli", "b")
    assert code == 1 and "no session b" in error
    assert run("extract", "--history", "none", "--session", "claude_cli", "a")[1] == [{"sessions": 1, "timeline_rows": 0, "examples": 0}]
    assert run("labels")[1][0]["examples"] == 0 and run("export", f"{tmp_path}/labels")[0] == 0


def test_side_chain_ids(spark):
    u = "00000000-0000-4000-8000-000000000001"
    rows = [(1, "claude_cli", u, None, None), (2, "claude_cli", "agent-a", 1, "/x"), (3, "claude_cli", "agent-b", None, f"/p/{u}/subagents/agent-b.jsonl"), (4, "claude_cli", "agent-c", None, "/p/short/subagents/agent-c.jsonl"), (5, "codex_cli", "agent-d", 1, "/x"), (6, "claude_cli", "agent-e", 99, f"/p/{u}/subagents/agent-e.jsonl"), (7, "claude_cli", "agent-f", None, None)]
    df = spark.createDataFrame(rows, "session_id long, source string, source_session_id string, parent_session_id long, file_path string")
    assert sorted(map(tuple, journal.sidechain_ids(df).collect())) == [(2, f"{u}/subagents/agent-a"), (3, f"{u}/subagents/agent-b")]


def test_addresses_and_pages(spark):
    row = lambda x: spark.createDataFrame([(x,)], "x string")
    for given, want in (("a%20b+c", "a b c"), ("%", "%"), ("%4", "%4"), ("100%zz", "100%zz"), ("%C3%A9%e4", "é�"), ("", ""), ("é%2B", "é+"), ("%25%32%35", "%25"), ("%41BC", "ABC")):
        df = row(given)
        assert df.select(text.percent_decoded(df["x"])).first()[0] == want, given
    df = row("/view?q=a%26b&session=s+1&q=last&flag&=x&e==1")
    assert df.select(text.query_values(df["x"])).first()[0] == {"session": "s 1", "q": "last", "flag": "", "": "x", "e": "=1"}
    df = row("/view")
    assert df.select(text.query_values(df["x"])).first()[0] == {}
    df = row("<a href='x'>\"&\"</a>")
    assert df.select(text.html_escaped(df["x"])).first()[0] == "&lt;a href=&#39;x&#39;&gt;&quot;&amp;&quot;&lt;/a&gt;"
