import json
import os
import sqlite3

import pytest

from loomlog.plans import ingest
from loomlog.plans.store import Store
from loomlog.plans.view import dump_events, show_timeline, view_of
from loomlog.sources import contents, files

U = "00000000-0000-4000-8000-0000000000"


def write(path, *lines, tail=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines) + tail)


def stamp(n, kind="user", **more):
    return {"type": kind, "timestamp": f"2026-05-05T01:00:{n:02}.000Z", **more}


@pytest.fixture(scope="module")
def journey(spark, tmp_path_factory):
    """A home, its journal, and what each pass over it reported."""
    home = str(tmp_path_factory.mktemp("home"))
    store = Store(spark, str(tmp_path_factory.mktemp("journal")) + "/j")
    claude = f"{home}/.claude/projects/-work"
    grow, cut, fixed, bad, late = (f"{claude}/{U}{k}.jsonl" for k in (21, 22, 23, 24, 25))
    write(grow, stamp(0, cwd="/work"), stamp(1), stamp(2, cwd="/later"))
    write(f"{claude}/{U}21/subagents/agent-a1.jsonl", stamp(3), stamp(4))
    write(f"{claude}/{U}21/subagents/workflows/w1/journal.jsonl", stamp(5))
    write(cut, stamp(0), stamp(1), stamp(2), stamp(3))
    write(fixed, stamp(0), stamp(1))
    write(bad, stamp(0), '{"type": "user", broken', stamp(2))
    write(late, stamp(0), stamp(1), tail='{"type": "us')
    write(f"{home}/.claude/{U}26.jsonl", stamp(9))
    write(f"{home}/.claude/history.jsonl", stamp(9))
    write(f"{home}/.codex/sessions/2026/05/05/rollout-1.jsonl", {"type": "session_meta", "timestamp": "2026-05-05T09:00:00Z", "payload": {"id": f"{U}31", "cwd": "/codex"}}, {"type": "event_msg", "payload": {"timestamp": "2026-05-05T09:00:05Z"}})
    write(f"{home}/.codex/archived_sessions/old.jsonl", {"id": f"{U}32", "timestamp": "2026-03-28T10:00:00Z"}, {"type": "x"})
    write(f"{home}/.codex/archived_sessions/headless.jsonl", {"type": "other"})
    write(f"{home}/.codex/sessions/empty.jsonl")
    agent = f"{home}/Library/Application Support/Claude/local-agent-mode-sessions/d/w/local_x1"
    write(f"{agent}/audit.jsonl", {"session_id": "x1-real", "_audit_timestamp": "2026-05-05T02:00:01Z", "type": "a"})
    write(f"{agent}.json", {"cwd": "/agent", "createdAt": 1777946400000, "lastActivityAt": "2026-05-05T03:00:00Z"})
    pi = f"{home}/.pi/agent/sessions/--w--/2026-05-06T02_{U}64"
    write(f"{pi}.jsonl", {"type": "session", "id": f"{U}64", "timestamp": "2026-05-06T02:00:00Z"}, {"type": "message"})
    write(f"{pi}/abc12345/run-0/session.jsonl", {"type": "session", "id": f"{U}65"}, {"type": "message"})
    write(f"{home}/.pi/agent/sessions/--w--/2026_other.jsonl", {"type": "session", "id": "not-the-name"})
    gemini = f"{home}/.gemini/tmp/proj/chats/s.json"
    os.makedirs(os.path.dirname(gemini))
    raw = '{"a" : 1,  "timestamp":"2026-05-06T09:00:00Z"}'
    with open(gemini, "w") as f:
        f.write('{"sessionId": "g1", "projectHash": "ph", "messages": [' + raw + ', {"timestamp": "2026-05-06T09:01:00Z"}], "x": {"messages": [1]}}')
    write(f"{home}/.factory/sessions/-w/f1.jsonl", {"type": "session_start", "id": "fac"}, {"type": "message", "timestamp": "2026-05-07T00:00:00Z"})
    write(f"{home}/.factory/sessions/-w/f1.settings.json", {"model": "m"})
    with sqlite3.connect(_dir(f"{home}/.local/share/opencode/opencode.db")) as c:
        for name, columns in contents_of("OPENCODE").items():
            c.execute(f'create table "{name}" ({columns})')
        c.execute("insert into project (id, worktree, time_created, time_updated, sandboxes) values ('p', '/oc', 1, 2, '[1]')")
        c.execute("insert into session (id, project_id, slug, directory, title, version, time_created, time_updated) values ('ses_1', 'p', 's', '/oc', 't', '1', 1770000000000, 1770000001000)")
        c.execute("insert into session (id, project_id, parent_id, slug, directory, title, version, time_created, time_updated) values ('ses_2', 'gone', 'ses_1', 's', '/oc', 't', '1', 1770000000500, 1770000001000)")
        c.execute("insert into message values ('m1', 'ses_1', 1770000000100, 1, '{\"role\": \"user\"}')")
        c.execute("insert into part values ('q1', 'm1', 'ses_1', 1770000000100, 1, 'no json')")
        c.execute("insert into session_message values ('k1', 'ses_1', 'note', 1770000000050, 1, '{}')")
    with sqlite3.connect(_dir(f"{home}/.hermes/state.db")) as c:
        for name, columns in contents_of("HERMES").items():
            c.execute(f'create table "{name}" ({columns})')
        c.execute("insert into sessions (id, source, started_at) values ('h1', 'cli', 1770000000.123456)")
        for k, t in ((12, 1770000001.0), (10, 1770000002.5), (11, 1770000002.5)):
            c.execute("insert into messages (id, session_id, role, timestamp) values (?, 'h1', 'user', ?)", (k, t))
    reports = [ingest.run(spark, home, store, "2026-06-01T00:00:00.000Z"), ingest.run(spark, home, store, "2026-06-01T01:00:00.000Z")]
    first = snapshot(store)
    with open(grow, "a") as f:
        f.write(json.dumps(stamp(7)) + "\n")
    with open(late, "a") as f:
        f.write('er", "timestamp": "2026-05-05T01:00:02.000Z"}\n')
    write(cut, stamp(0), stamp(9))
    write(fixed, stamp(8), stamp(9))
    write(bad, stamp(0), stamp(1), stamp(2))
    os.utime(f"{home}/.factory/sessions/-w/f1.jsonl", (1, 1))
    write(f"{home}/.factory/sessions/-w/f1.settings.json", {"model": "m2"})
    os.utime(f"{home}/.factory/sessions/-w/f1.settings.json", (2, 2))
    reports.append(ingest.run(spark, home, store, "2026-06-02T00:00:00.000Z"))
    return store, reports, first, snapshot(store), raw


def _dir(path):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def contents_of(name):
    from loomlog.sources import sqlite

    return {t: c.replace(" string", " text").replace(" long", " integer").replace(" double", " real") for t, c in getattr(sqlite, name).items()}


def snapshot(store):
    sessions = {(r.source, r.source_session_id): r for r in store.table("sessions").collect()}
    events = {}
    for r in store.table("events").orderBy("session_id", "generation", "seq").collect():
        events.setdefault(r.session_id, []).append(r)
    return sessions, events, store.table("ingest_errors").collect()


def per_generation(snap, key):
    sessions, events, _ = snap
    found = {}
    for r in events.get(sessions[key].session_id, []):
        found[r.generation] = found.get(r.generation, 0) + 1
    return found


def test_sessions_of_all_tools(journey):
    _, reports, first, _, _ = journey
    sessions, events, errors = first
    assert {k: r.event_count for k, r in sessions.items()} == {
        ("claude_cli", f"{U}21"): 3, ("claude_cli", f"{U}21/subagents/agent-a1"): 2, ("claude_cli", f"{U}21/subagents/workflows/w1/journal"): 1, ("claude_cli", f"{U}22"): 4, ("claude_cli", f"{U}23"): 2,
        ("claude_cli", f"{U}24"): 1, ("claude_cli", f"{U}25"): 2, ("claude_cli", f"{U}26"): 1, ("codex_cli", f"{U}31"): 2, ("codex_cli", f"{U}32"): 2, ("claude_local_agent", "x1-real"): 1, ("pi_agent", f"{U}64"): 2,
        ("pi_agent", f"{U}65"): 2, ("gemini_cli", "g1"): 2, ("factory", "fac"): 2, ("opencode", "ses_1"): 4, ("opencode", "ses_2"): 1, ("hermes", "h1"): 4,
    }
    assert reports[0]["inserted_events"] == 38 and reports[0]["error_files"] == 2 and reports[1]["inserted_events"] == 0
    parents = {k[1]: r.parent_session_id for k, r in sessions.items() if r.parent_session_id}
    ids = {k[1]: r.session_id for k, r in sessions.items()}
    assert parents == {f"{U}21/subagents/agent-a1": ids[f"{U}21"], f"{U}21/subagents/workflows/w1/journal": ids[f"{U}21"], f"{U}65": ids[f"{U}64"], "ses_2": ids["ses_1"]}


def test_metadata(journey):
    sessions, events, _ = journey[2]
    grow = sessions["claude_cli", f"{U}21"]
    assert (grow.cwd, grow.started_at, grow.ended_at) == ("/work", "2026-05-05T01:00:00.000Z", "2026-05-05T01:00:02.000Z")
    agent = sessions["claude_local_agent", "x1-real"]
    assert (agent.cwd, agent.started_at) == ("/agent", "2026-05-05T02:00:01Z")
    assert sessions["codex_cli", f"{U}31"].cwd == "/codex" and sessions["codex_cli", f"{U}31"].ended_at == "2026-05-05T09:00:05Z"
    assert sessions["gemini_cli", "g1"].cwd == "ph"
    assert json.loads(sessions["factory", "fac"].source_metadata)["settings"] == {"model": "m"}
    assert sessions["hermes", "h1"].started_at == "2026-02-02T02:40:00.123Z"


def test_events_as_written(journey):
    sessions, events, _ = journey[2]
    of = lambda key: [bytes(r.payload) for r in events[sessions[key].session_id]]
    assert of(("gemini_cli", "g1"))[0].decode() == journey[4]
    rows = [json.loads(p) for p in of(("opencode", "ses_1"))]
    assert [r["table"] for r in rows] == ["session", "session_message", "message", "part"]
    assert rows[0]["project"]["sandboxes"] == [1] and rows[2]["row"]["data"] == {"role": "user"} and rows[3]["row"]["data"] == "no json"
    assert [json.loads(p)["row"]["id"] for p in of(("hermes", "h1"))] == ["h1", 12, 10, 11]
    assert json.loads(of(("opencode", "ses_2"))[0])["project"]["id"] is None


def test_errors_and_their_end(journey):
    _, reports, first, last, _ = journey
    found = {(r.file_path.rsplit("/", 1)[-1], r.error_kind): r for r in first[2]}
    line = found[f"{U}24.jsonl", "invalid_json"]
    assert (line.line_number, line.occurrence_count, line.resolved_at) == (2, 1, None)  # the same bytes are not read again
    assert {k for k in found} == {(f"{U}24.jsonl", "invalid_json"), ("headless.jsonl", "invalid_session_meta"), ("2026_other.jsonl", "invalid_session_meta")}
    after = {(r.file_path.rsplit("/", 1)[-1], r.error_kind): r for r in last[2]}
    assert after[f"{U}24.jsonl", "invalid_json"].resolved_at == "2026-06-02T00:00:00.000Z"
    assert after["headless.jsonl", "invalid_session_meta"].resolved_at is None


def test_growth_and_rewrites(journey):
    _, reports, first, last, _ = journey
    assert per_generation(last, ("claude_cli", f"{U}21")) == {0: 4}
    assert per_generation(last, ("claude_cli", f"{U}22")) == {0: 4, 1: 2} and last[0]["claude_cli", f"{U}22"].event_count == 2
    assert per_generation(last, ("claude_cli", f"{U}23")) == {0: 2, 1: 2}
    assert per_generation(last, ("claude_cli", f"{U}24")) == {0: 3}
    assert per_generation(last, ("claude_cli", f"{U}25")) == {0: 3}
    assert per_generation(last, ("factory", "fac")) == {0: 2} and last[0]["factory", "fac"].file_mtime == 1
    assert reports[2]["inserted_events"] == 8
    assert json.loads(last[0]["factory", "fac"].source_metadata)["settings"] == {"model": "m2"}


def test_views(journey, spark, tmp_path):
    store = journey[0]
    view = view_of(store, search="codex_CLI")
    assert {r.source_session_id for r in view["sessions"].collect()} == {f"{U}31", f"{U}32"} and not view["has_next"]
    chosen = view["selected"]
    assert chosen.source == "codex_cli" and view["events"].count() == 2 and "payload" not in view["events"].columns
    view = view_of(store, search="session_meta", session_id=chosen.session_id, expanded=(0, 0))
    assert [r.source_session_id for r in view["sessions"].collect()] == [f"{U}31"] and view["preview"].startswith('{"') and view["errors"].count() == 2
    assert view_of(store, search="no such thing")["selected"] is None
    dump_events(store, "claude_cli", f"{U}21", str(tmp_path / "dump"), 2)
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "dump")).collect()] == [stamp(0, cwd="/work"), stamp(1)]
    with pytest.raises(LookupError):
        dump_events(store, "claude_cli", "none", str(tmp_path / "other"))


def test_extraction_of_a_journal(spark, tmp_path):
    home, store = str(tmp_path / "h"), Store(spark, str(tmp_path / "j"))
    main = f"{home}/.claude/projects/-w/{U}31"
    use = lambda n, ts, path: {"type": "assistant", "timestamp": ts, "cwd": "/w", "message": {"content": [{"type": "tool_use", "id": n, "name": "Edit", "input": {"file_path": path, "new_string": "x"}}]}}
    snap = lambda ts, **files: {"type": "file-history-snapshot", "snapshot": {"timestamp": ts, "trackedFileBackups": {k: {"backupFileName": v} for k, v in files.items()}}}
    write(f"{main}.jsonl", use("t1", "1", "/w/a"), snap("2", a="b@v1"), use("t2", "5", "b"), snap("6", b="gone"))
    write(f"{main}/subagents/agent-1.jsonl", use("t3", "3", "a"), snap("4", a="b@v2"))
    write(f"{home}/.claude/file-history/{U}31/b@v1", "one")
    write(f"{home}/.claude/file-history/{U}31/b@v2", "one", "two")
    ingest.run(spark, home, store)
    history = f"{home}/.claude/file-history"
    assert ingest.extract(spark, store, history) == {"sessions": 1, "timeline_rows": 3, "examples": 3}
    got = {r.tool_use_id: (r.outcome, r.evidence_kind) for r in store.table("preference_examples").collect()}
    assert got == {"t1": ("accepted", "direct_edit"), "t2": ("rejected", "missing_final_state"), "t3": ("accepted", "direct_edit")}
    assert ingest.extract(spark, store, history)["sessions"] == 0 and store.table("preference_examples").count() == 3
    assert show_timeline(store, "claude_cli", f"{U}31", "/w/a").count() == 2
    with pytest.raises(LookupError):
        show_timeline(store, "claude_cli", f"{U}31", "nothing")
    write(f"{main}.jsonl", snap("1", z="b@v1"))
    ingest.run(spark, home, store)
    assert ingest.extract(spark, store, history)["examples"] == 1 and store.table("file_timelines").count() == 2
    assert len(store.vacuum()) > 0 and store.check() == [] and store.table("preference_examples").count() == 1
    store.pack(str(tmp_path / "packed"))
    other = Store(spark, str(tmp_path / "other"))
    other.restore(str(tmp_path / "packed"))
    assert other.table("file_timelines").count() == 2 and ingest.extract(spark, other, history)["sessions"] == 0


def test_pack_restore_and_compaction(journey, spark, tmp_path):
    store = journey[0]
    store.pack(str(tmp_path / "packed"))
    with pytest.raises(FileExistsError):
        store.pack(str(tmp_path / "packed"))
    other = Store(spark, str(tmp_path / "other"))
    other.restore(str(tmp_path / "packed"))
    assert other.check() == [] and other.table("events").count() == store.table("events").count()
    report = ingest.compact(other, apply=True)
    assert report["compact"] == 0 and report["small"] == 46
    assert other.vacuum() == []
    with pytest.raises(RuntimeError):
        with other.writing(), other.writing():
            pass


def test_missing_home(spark, tmp_path):
    store = Store(spark, str(tmp_path / "j"))
    assert ingest.run(spark, str(tmp_path / "nothing"), store)["files"] == 0


@pytest.mark.parametrize("data, start, want", [
    (b"", 0, []),
    (b"{}\n{}\n", 0, [(0, 0), (1, 3)]),
    (b"{}\n{}\n", 3, [(1, 3)]),
    (b"{}\n\n{}\n", 0, [(0, 0), (1, 3)]),
    (b'{"id": 1}\n{}\n', 0, [(0, 0)]),
    (b'{"cwd": "\\u0041"}\r\n', 0, [(0, 0)]),
])
def test_lines(data, start, want):
    rows = list(contents.lines_of("claude_cli", "p", data, 0, 0, start, contents.committed(data)))
    assert [(r[1], r[2]) for r in rows] == want
    assert all(r[7] is None for r in rows[:-1])


def test_ids_from_paths(spark):
    df = spark.createDataFrame([(f"/h/.claude/projects/x/{U}21/subagents/agent-1.jsonl",), (f"/h/.claude/projects/x/{U}21/other/agent-1.jsonl",), ("/h/.claude/projects/x/plain.name.jsonl",)], "path string")
    own, parent = files.claude_ids(df["path"])
    assert [tuple(r) for r in df.select(own, parent).collect()] == [(f"{U}21/subagents/agent-1", f"{U}21"), ("agent-1", None), ("plain.name", None)]


def opencode(home):
    with sqlite3.connect(_dir(f"{home}/.local/share/opencode/opencode.db")) as c:
        for name, columns in contents_of("OPENCODE").items():
            c.execute(f'create table "{name}" ({columns})')
        for k in (1, 2):
            c.execute("insert into session (id, project_id, slug, directory, title, version, time_created, time_updated) values (?, 'p', 's', '/oc', 't', '1', 1770000000000, 1770000001000)", (f"ses_{k}",))
            c.execute("insert into message values (?, ?, 1770000000100, 1, '{}')", (f"m{k}", f"ses_{k}"))


@pytest.mark.parametrize("broken, what", [("no database", "file is not a database"), ("no table", 'sessions has no "id"'), ("blank id", "no id"), ("no column", 'messages has no "session_id"')])
def test_what_is_wrong_with_a_store(tmp_path, broken, what):
    from loomlog.sources import sqlite as stores

    bad = str(tmp_path / "state.db")
    break_store(bad, broken)
    assert what in stores.problem(bad, "hermes", stores.HERMES, "sessions")


def break_store(bad, broken):
    if broken == "no database":
        with open(bad, "w") as f:
            f.write("not a sqlite database")
    else:
        with sqlite3.connect(bad) as c:
            if broken != "no table":
                for name, columns in contents_of("HERMES").items():
                    c.execute(f'create table "{name}" ({columns if broken == "blank id" or name != "messages" else "id integer"})')
                c.execute("insert into sessions (id, source) values (?, 'cli')", (" " if broken == "blank id" else "h1",))
            else:
                c.execute("create table other (id text)")


def test_a_broken_store_blocks_nothing_else(spark, tmp_path):
    home, store = str(tmp_path / "h"), Store(spark, str(tmp_path / "j"))
    write(f"{home}/.claude/projects/-w/{U}41.jsonl", stamp(0), stamp(1))
    opencode(home)
    bad = _dir(f"{home}/.hermes/state.db")
    break_store(bad, "no database")
    report = ingest.run(spark, home, store, "2026-06-01T00:00:00.000Z")
    assert report["inserted_events"] == 6 and report["error_files"] == 1
    sessions, _, errors = snapshot(store)
    assert {k: r.event_count for k, r in sessions.items()} == {("claude_cli", f"{U}41"): 2, ("opencode", "ses_1"): 2, ("opencode", "ses_2"): 2, ("hermes", "state.db"): 0}
    (error,) = errors
    assert (error.source, error.source_session_id, error.file_path, error.error_kind, error.occurrence_count) == ("hermes", "state.db", bad, "invalid_session_meta", 1) and "Hermes SQLite SessionDB" in error.message
    with open(f"{home}/.local/share/opencode/opencode.db", "w") as f:  # a store that was read before
        f.write("not a sqlite database anymore")
    assert ingest.run(spark, home, store, "2026-06-02T00:00:00.000Z")["inserted_events"] == 0
    sessions, events, errors = snapshot(store)
    assert len(sessions) == 5 and sum(map(len, events.values())) == 6
    assert {(e.source, e.source_session_id, e.occurrence_count, e.resolved_at) for e in errors} == {("hermes", "state.db", 2, None), ("opencode", "opencode.db", 1, None)}
    os.remove(f"{home}/.local/share/opencode/opencode.db")
    opencode(home)
    assert ingest.run(spark, home, store, "2026-06-03T00:00:00.000Z")["inserted_events"] == 0
    assert {e.source: e.resolved_at for e in snapshot(store)[2]} == {"hermes": None, "opencode": "2026-06-03T00:00:00.000Z"}


def test_a_file_in_ranges(spark, tmp_path, monkeypatch):
    """Files longer than a range are imported by several tasks; a bad line stops them all behind it."""
    home, store = str(tmp_path / "h"), Store(spark, str(tmp_path / "j"))
    path = f"{home}/.claude/projects/-w/{U}51.jsonl"
    n = 3 * contents.RANGE_BYTES // 100_000
    lines = [{"type": "user", "timestamp": str(i), "text": "x" * 99_900} for i in range(n)]
    write(path, *lines)
    assert ingest.run(spark, home, store)["inserted_events"] == n
    (session,) = store.table("sessions").collect()
    assert (session.next_read_offset, session.prefix_fingerprint, session.content_fingerprint) == (os.path.getsize(path), contents.fingerprint(open(path, "rb").read()), session.prefix_fingerprint)
    assert [r.seq for r in store.table("events").orderBy("seq").select("seq").collect()] == list(range(n))
    other = f"{home}/.claude/projects/-w/{U}52.jsonl"
    write(other, *lines[: n // 2], "broken", *lines[n // 2 :], "broken, too")
    assert ingest.run(spark, home, store)["inserted_events"] == n // 2
    assert [(e.line_number, e.error_kind) for e in store.table("ingest_errors").collect()] == [(n // 2 + 1, "invalid_json")]
    row = store.table("sessions").where(f"source_session_id = '{U}52'").first()
    assert row.event_count == n // 2 and row.prefix_fingerprint == contents.fingerprint(open(other, "rb").read()[: row.next_read_offset])


def test_an_appended_line_needs_one_pass(tmp_path, monkeypatch):
    """The file once for the hash of its prefix, and of its lines the new one only."""
    path, read = str(tmp_path / "f.jsonl"), []
    write(path, *[{"n": i, "x": "y" * 1000} for i in range(3000)])
    old = os.path.getsize(path)
    before = contents.scan(path, old, 0, None)
    with open(path, "a") as f:
        f.write('{"n": "new"}\n')
    size = os.path.getsize(path)

    class Counted:
        def __init__(self, file):
            self.file = file

        def read(self, n=-1):
            data = self.file.read(n)
            read.append(len(data))
            return data

        def seek(self, at):
            self.file.seek(at)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    monkeypatch.setattr(contents, "opened", lambda p: Counted(open(p, "rb")))
    whole, end, at_end, intact, marks = contents.scan(path, size, old, before[2])
    assert intact and (end, marks) == (size, [[0, 0], [old, 3000]]) and whole == at_end and sum(read) == size
    read.clear()
    data = contents.read_bounded(path, end, old)
    (line,) = contents.lines_of("claude_cli", path, data, old, 3000, old, end)
    assert line[1:4] == (3000, old, size) and sum(read) == size - old < 100
    assert not contents.scan(path, size, old, "another")[3] and contents.scan(path, size, old, None)[3] and not contents.scan(path, old - 5, old, before[2])[3]
    for n in (0, 1, 999, 2**20, 2**20 + 7, old - 1):  # all sizes, with and without a line begun
        with open(path, "rb") as f:
            known = f.read(n)
        got = contents.scan(path, n, 0, None)
        assert got[:3] == (contents.fingerprint(known), contents.committed(known), contents.fingerprint(known[: contents.committed(known)]))


def test_two_files_of_one_session(spark, tmp_path):
    """A moved file is the same session; of two at once the first by path is imported, and the other, which isn't its continuation, rewrites it."""
    home, store = str(tmp_path / "h"), Store(spark, str(tmp_path / "j"))
    head = {"type": "session_meta", "payload": {"id": f"{U}61"}}
    live, moved = f"{home}/.codex/sessions/2026/r.jsonl", f"{home}/.codex/archived_sessions/r.jsonl"
    write(live, head, {"n": 1})
    assert ingest.run(spark, home, store)["inserted_events"] == 2
    os.makedirs(os.path.dirname(moved))
    os.rename(live, moved)
    assert ingest.run(spark, home, store)["inserted_events"] == 0
    assert [(r.file_path, r.event_count) for r in store.table("sessions").collect()] == [(moved, 2)]
    with open(moved, "a") as f:
        f.write('{"n": 2}\n')
    write(live, head, {"n": 9}, {"n": 8}, {"n": 7})
    assert ingest.run(spark, home, store)["inserted_events"] == 1
    (row,) = store.table("sessions").collect()
    assert (row.file_path, row.current_generation, row.event_count) == (moved, 0, 3)
    assert ingest.run(spark, home, store)["inserted_events"] == 4
    (row,) = store.table("sessions").collect()
    assert (row.file_path, row.current_generation, row.event_count) == (live, 1, 4)


def test_sparse_rowids(spark, tmp_path, monkeypatch):
    from loomlog.sources import sqlite

    monkeypatch.setattr(sqlite, "ROWS_PER_PARTITION", 3)
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (id integer primary key, v text)")
        c.executemany("insert into t values (?, 'v')", [(k,) for k in (1, 2, 3, 4, 10**12, 10**15, 2**62)])
        c.execute("create table empty (v text)")
    from pyspark.sql.types import StructType

    reader = sqlite.TableReader(StructType().add("id", "long"), {"path": path, "table": "t"})
    assert [(p.low, p.high) for p in reader.partitions()] == [(1, 4), (4, 2**62), (2**62, 2**62 + 1)]
    assert sorted(r.id for r in sqlite.read_table(spark, path, "t", "id long").collect()) == [1, 2, 3, 4, 10**12, 10**15, 2**62]
    assert sqlite.read_table(spark, path, "empty", "v string").count() == 0
