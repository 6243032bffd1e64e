import json

import pytest
from pyspark.sql import functions as F

from loomlog.operators import taste
from loomlog.tables import stored


def use(n, tool, ts, ref=None, **given):
    return {"type": "assistant", "timestamp": ts, "message": {"content": [{"type": "text", "text": "x"}, {"type": "tool_use", "id": ref or f"t{n}", "name": tool, "input": given}]}}


def result(n, ts, content="done"):
    return {"type": "user", "timestamp": ts, "message": {"content": [{"type": "tool_result", "tool_use_id": f"t{n}", "content": content}]}}


def inline(ts, **files):
    return {"type": "file-history-snapshot", "snapshot": {"timestamp": ts, "trackedFileBackups": [{"filePath": k, "content": v} for k, v in files.items()]}}


def side(ts, **files):
    return {"type": "file-history-snapshot", "snapshot": {"timestamp": ts, "trackedFileBackups": {k: {"backupFileName": v, "version": 1} for k, v in files.items()}}}


MAIN = [
    inline("01", **{"a.py": "one\n"}),
    use(1, "Edit", "02", file_path="/w/a.py", new_string="two"),
    result(1, "03"),
    inline("04", **{"/w/a.py": "one\ntwo\nthree\n"}),
    use(2, "Edit", "05", file_path="a.py", new_string="denied"),
    result(2, "06", [{"type": "text", "text": "new_string was NOT written to disk"}]),
    use(3, "Write", "07", path="b.rs", content="fresh"),
    result(3, "08"),
    side("09", **{"b.rs": "b1"}),
    use(4, "Bash", "10", command="echo more >> src/c.ts"),
    inline("11", **{"src/c.ts": "more\n"}),
    use(5, "Edit", "12", file_path="a.py", new_string="kept\nlost"),
    inline("13", **{"a.py": "one\nkept\nlost\n"}),
    inline("14", **{"a.py": "one\nkept\n"}),
    use(6, "mcp_tool", "15", file_path="d.md", content="m"),
    inline("16", **{"d.md": "m\n"}),
    use(7, "Edit", "17", file_path="e.md", new_string="z"),
    side("18", **{"e.md": "gone"}),
    use(8, "Edit", "19", file_path="nowhere.md", new_string="q"),
    use(9, "Write", "20", file_path="unseen.md", content="q"),
    result(9, "21"),
    use(10, "Bash", "22", command="ls"),
    use(11, "Read", "23", file_path="a.py"),
    use(12, "Edit", "24", path=7, file_path=None),
    "broken",
]
SIDE = [use(20, "Edit", "12.5", file_path="f.md", new_string="sub"), inline("12.6", **{"f.md": "sub\n"})]


@pytest.fixture(scope="module")
def compiled(spark):
    rows = [("claude_cli", "s", 0, None, i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(MAIN)]
    rows += [("claude_cli", "s", 1, "agent-1", i, json.dumps(x)) for i, x in enumerate(SIDE)]
    lines = spark.createDataFrame(rows, "source string, source_session_id string, stream_idx int, agent_id string, line_seq long, payload string")
    sessions = spark.createDataFrame([("claude_cli", "s", "/w/")], "source string, source_session_id string, cwd string")
    blobs = spark.createDataFrame([("s", "b1", "fresh\n")], "source_session_id string, backup_name string, blob string")
    timeline, examples = taste.extract(lines, sessions, blobs, stored)
    return timeline, stored(examples, "examples"), lines


def test_labels(compiled):
    got = {r.tool_use_id: (r.outcome, r.confidence, r.evidence_kind, r.file_path) for r in compiled[1].collect()}
    assert got == {
        "t1": ("rejected", 1.0, "direct_edit", "a.py"),
        "t2": ("rejected", 1.0, "permission_denial", "a.py"),
        "t3": ("accepted", 1.0, "direct_write", "b.rs"),
        "t4": ("accepted", 0.6, "bash_correlation", "src/c.ts"),
        "t5": ("edited", 0.5, "direct_edit", "a.py"),
        "t6": ("accepted", 0.6, "mcp_correlation", "d.md"),
        "t7": ("rejected", 0.3, "missing_final_state", "e.md"),
        "t8": ("rejected", 0.3, "missing_final_state", "nowhere.md"),
        "t9": ("accepted", 0.4, "missing_final_state", "unseen.md"),
        "t10": ("rejected", 0.2, "missing_final_state", None),
        "t12": ("rejected", 0.2, "missing_final_state", None),
        "t20": ("accepted", 1.0, "direct_edit", "f.md"),
    }


def test_timeline(compiled):
    rows = {(r.file_path, r.seq): (r.content, r.trigger_event_ref, r.source_kind) for r in compiled[0].collect()}
    assert rows["a.py", 0] == ("one\n", None, "inline_snapshot") and rows["a.py", 1][1] == "t1" and rows["a.py", 3] == ("one\nkept\n", "t5", "inline_snapshot")
    assert rows["b.rs", 0] == ("fresh\n", "t3", "sidecar_snapshot") and rows["e.md", 0] == (None, "t7", "missing_sidecar")
    assert len(rows) == 9


def test_order_and_context(compiled):
    rows = {r.tool_use_id: r for r in compiled[1].collect()}
    assert [r.generation for r in sorted(rows.values(), key=lambda r: r.proposal_event_seq)] == list(range(12))
    assert rows["t3"].context is None and rows["t2"].context.endswith("--- file before ---\none\ntwo\nthree\n")
    first = rows["t1"]
    assert first.context == "one\n"
    assert rows["t2"].context.startswith(f"--- prior events ---\n[seq={first.proposal_event_seq} tool_proposal Edit /w/a.py]\n[seq={first.proposal_event_seq + 1} tool_result t1]\n\n")
    assert rows["t5"].context.count("[seq=") == 5


def test_status_and_export(compiled, spark, tmp_path):
    got = taste.status(compiled[1]).first()
    assert (got.examples, got.accepted, got.rejected, got.edited, got.high_confidence, got.permission_denial) == (12, 5, 6, 1, 4, 1)
    assert taste.status(compiled[1].where("false")).first().high_percent == 0.0
    taste.export(compiled[1], str(tmp_path / "x"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "x")).collect()]
    assert len(lines) == 12 and all(set(x) >= {"context", "chosen", "rejected"} for x in lines) and sum(x["chosen"] is not None for x in lines) == 6
    with pytest.raises(Exception):
        taste.export(compiled[1], str(tmp_path / "x"))


def test_pending(spark):
    s = spark.createDataFrame([("c", "a", 3), ("c", "b", 3), ("c", "n", None)], "source string, source_session_id string, event_count long")
    done = spark.createDataFrame([("c", "a", "taste-1", 3), ("c", "b", "taste-1", 2)], "source string, source_session_id string, extractor_version string, event_count long")
    assert {r.source_session_id for r in taste.pending(s, done).collect()} == {"b", "n"}
    assert taste.pending(s, done, version="taste-2").count() == 3 and taste.pending(s, done, force=True).count() == 3


def test_exactly_one(compiled):
    assert taste.found_or_none(compiled[1], F.col("tool_use_id") == "t1").generation == 0
    with pytest.raises(LookupError, match="not found"):
        taste.found_or_none(compiled[1], F.col("tool_use_id") == "no")
    with pytest.raises(LookupError, match="ambiguous"):
        taste.found_or_none(compiled[1], F.col("tool_name") == "Edit")


def test_errors_are_rows(compiled):
    assert taste.parse(compiled[2]).where("kind = 'error'").count() == 1
