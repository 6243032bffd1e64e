"""The general operators p1, p2, p4 and p6 against brute force, and their edge cases."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from loomlog.functions.strictjson import _slow, load_object, loads, type_name
from loomlog.operators import instants, nested, parse_failures, schema_drift
from loomlog.plans import general
from loomlog.tables import stored, table

D = "/root/testdata/sf0.001"
LINES = "line_id long, file_id long, source string, line_number long, byte_offset long, raw_line string, `select` string"

JSON_TEXTS = [
    '{"a":1}', '{"a":1} x', '{"a":1}}', '{"a":1}]', '{"a":1},{"b":2}', '{"a":1},"k":1', '{"a":01}', '{"a":1e999}', '{"a":.5}', '{"a":5.}', "{'a':1}", "{a:1}", '{"a":NaN}', "﻿{}", " {}", " {}\r\n\t", "{}\x00",
    '{"a":"\\ud800"}', '{"a":1,"a":2}', '{"a":' * 1500 + "1" + "}" * 1500, '{"a":' + "9" * 5000 + "}", "", " ", '{"a":/*x*/1}', '{"a":1}//x', '{"a":"\\x"}', '{"a":1}],[', '{"a":1}\n{"b":1}', '{"a":tru}',
    '{"a":"x\ty"}', '{"a":+1}', '{"a":1,}', "[1]", '"x"', "null", "12", '{"line":1},"_corrupt":"x"', '{"a":1}}{"line":{}', None, '{"a": -0}', '{"a": -}', '{"a":Infinity}', '{"a":"' + "x" * 300_000 + '"}', "[" * 3000 + "]" * 3000,
]


def line_rows(texts):
    return [(i, 1, "s", i, i * 10, x, "y") for i, x in enumerate(texts)]


def brute_json(x):
    try:
        return None if isinstance(loads(x), dict) else "not_object"
    except (ValueError, TypeError):
        return "not_json"


def test_lines_that_do_not_parse(spark):
    got = {r.record_id: r.reason for r in parse_failures.rejected_lines(spark.createDataFrame(line_rows(JSON_TEXTS), LINES)).collect()}
    assert got == {i: w for i, x in enumerate(JSON_TEXTS) if (w := brute_json(x))}
    assert parse_failures.rejected_lines(spark.createDataFrame([], LINES)).count() == 0


@pytest.mark.parametrize("x", [x for x in JSON_TEXTS if x is not None])
def test_both_readers_agree(x):
    try:
        want = json.loads(x, parse_constant=lambda c: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        return
    assert type_name(_slow(x)) == type_name(want)


def brute_record(s):
    if s is None:
        return "column_count"
    fields, i = [], 0
    while True:
        if s[i : i + 1] == '"':
            i, value = i + 1, ""
            while True:
                k = s.find('"', i)
                if k < 0:
                    return "quoting"
                value, i = value + s[i:k], k + 1
                if s[i : i + 1] != '"':
                    break
                value, i = value + '"', i + 1
            if i < len(s) and s[i] != ",":
                return "quoting"
        else:
            k = s.find(",", i)
            k = len(s) if k < 0 else k
            value, i = s[i:k], k
            if '"' in value:
                return "quoting"
        fields.append(value)
        if i >= len(s):
            break
        i += 1
    if len(fields) != 11:
        return "column_count"
    number = lambda x, least=0: x.isascii() and x.isdigit() and least <= int(x) < 2**63

    def time(x):
        try:
            return len(x) == 24 and x[10] == "T" and x[-1] == "Z" and x[19] == "." and x.isascii() and bool(dt.datetime.strptime(x, "%Y-%m-%dT%H:%M:%S.%fZ"))
        except ValueError:
            return False

    wrong = not (fields[0] and fields[2] and fields[7]) or any(x and not number(x) for x in fields[3:6]) or fields[6] not in parse_failures.ERROR_KINDS
    return "value" if wrong or not time(fields[8]) or not time(fields[9]) or not number(fields[10], 1) else None


def test_records_that_do_not_parse(spark):
    good = 'factory,id,/p,1,2,3,read_error,"m ""q"", x",2025-04-21T11:59:06.970Z,2024-02-29T08:06:40.357Z,7'
    texts = [good, good + ",", good.replace("2024-02-29", "2025-02-29"), good.replace(",7", ",0"), good.replace(",7", ",07"), good.replace(",1,2,3,", ",,,,"), good.replace(",1,", ",９,"), good.replace(",1,", ",9223372036854775808,"),
             good.replace(",1,", ",9223372036854775807,"), good.replace("factory", '""'), good.replace("factory", '"fac\ntory"'), good.replace("factory", '"fac"x'), good.replace("factory", 'fa"c'), good + '"', "", None, '"', '""', '"""', ",", "a\nb",
             good.replace("T11:59:06", "T24:00:00"), good.replace("T11:59:06", "T11:59:60"), good.replace("read_error", "Read_error"), good.replace("id", '"' + '""' * 20_000 + '"'), good + "\n"]
    r = random.Random(4)
    texts += ["".join(r.choice('a1",\n') for _ in range(r.randrange(12))) for _ in range(300)]
    for _ in range(300):
        k = r.randrange(len(good))
        texts.append(good[:k] + r.choice('",x\n') + good[k + r.randrange(2) :])
    df = spark.createDataFrame([(i, "f", i, x) for i, x in enumerate(texts)], "record_id long, report_file string, record_no long, raw_record string")
    got = {r.record_id: r.reason for r in parse_failures.read_records(df).select("record_id", "reason").collect()}
    assert {i: (texts[i], got[i], brute_record(x)) for i, x in enumerate(texts) if got[i] != brute_record(x)} == {}
    valid = {r.record_id: r for r in parse_failures.valid_records(df).collect()}
    assert valid[0].message == 'm "q", x' and valid[5].generation is None and valid[10].source == "fac\ntory"


def brute_drift(spark, d):
    files = {r.file_id: r for r in table(spark, d, "source_files").collect()}
    aliases = [(r.field_name, r.json_path) for r in table(spark, d, "field_aliases").collect()]
    state = {}
    for r in table(spark, d, "session_lines").collect():
        value = load_object(r.raw_line)
        if value is None:
            continue
        mine = state.setdefault(r.file_id, {})
        for field, path in aliases:
            at = value
            for step in path.split("."):
                at = at.get(step) if isinstance(at, dict) else None
            if at is not None:
                mine.setdefault(field, set()).add((path, type_name(at)))
    roots = {}
    for f in sorted((f for f in state if f in files), key=lambda f: files[f].opened_at):
        roots.setdefault(files[f].source_root, []).append(f)
    found = set()
    for chain in roots.values():
        for a, b in itertools.pairwise(chain):
            for field in {f for f, _ in aliases}:
                x, y = state[a].get(field, set()), state[b].get(field, set())
                if not x and y:
                    found.add((b, field, "added"))
                if x and not y:
                    found.add((b, field, "removed"))
                if x and y:
                    found |= {(b, field, "renamed")} if {p for p, _ in x} != {p for p, _ in y} else set()
                    found |= {(b, field, "retyped")} if {t for _, t in x} != {t for _, t in y} else set()
    return found


@pytest.mark.parametrize("d", [D, "/root/testdata/sf0.01"])
def test_drift_against_brute_force(spark, d):
    rows = [tuple(r) for r in general.p1_found(spark, d).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_drift(spark, d)


def with_parents(kinds):
    return kinds | {".".join(p.split(".")[:i]): {"object"} for p in kinds for i in range(1, p.count(".") + 1)}


def test_flooding_keeps_listed_paths(spark):
    aliases = schema_drift.alias_list(table(spark, D, "field_aliases"))
    r = random.Random(7)
    words = ["version", "cliVersion", "type", "kind", "payload", "body", "entry", "client", "data", "clientVersion", "semver", "event", "build", "app"]
    kinds = ["string", "number", "object", "array", "boolean"]
    for _ in range(300):  # whatever else there is, a listed path is selected as itself
        some = {".".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(30))} | {p for _, p in aliases if r.random() < 0.3}
        schema = with_parents({p: set(r.sample(kinds, r.randrange(1, 3))) for p in some})
        got = schema_drift.flood(schema, aliases)
        assert {(p, f) for p, f, q, _ in got if p == q} == {(p, f) for f, p in aliases if p in schema}
        assert len({p for p, *_ in got}) == len({q for _, _, q, _ in got}) == len(got)
    assert schema_drift.flood({}, aliases) == [] and schema_drift.flood({"x": {"string"}}, []) == []


def test_flooding_finds_the_field_of_names_that_are_not_listed(spark):
    aliases = schema_drift.alias_list(table(spark, D, "field_aliases"))
    lines = [r.raw_line for r in table(spark, D, "session_lines").collect()]
    schema: dict = {}
    for value in filter(None, map(load_object, lines)):
        for path, kind in schema_drift._paths(value, schema_drift.depth_of(aliases)):
            schema.setdefault(path, set()).add(kind)
    found = 0
    for field, hidden in aliases:  # each path in turn as one that isn't listed, alone of its field
        alone = {p: k for p, k in schema.items() if p == hidden or p not in {q for f, q in aliases if f == field}}
        got = {p: f for p, f, _, _ in schema_drift.flood(alone, [x for x in aliases if x[1] != hidden])}
        assert got.get(hidden, field) == field
        found += hidden in got
    assert found >= 4
    new = with_parents({"payload.clientVersion": {"string"}, "payload.id": {"string"}, "eventType": {"string"}, "message.version": {"number"}, "type.name": {"string"}, "attachment.type": {"string"}})
    assert {(p, f) for p, f, _, _ in schema_drift.flood(new, aliases)} == {("payload.clientVersion", "payload.cli_version"), ("eventType", "type"), ("type", "type")}


def test_names_that_are_data_and_depth():
    aliases = [("a", "a.b.c.d"), ("v", "version")]
    assert schema_drift.depth_of(aliases) == 4 and schema_drift.depth_of([]) == 1
    kinds = {f"k{i}": {"string"} for i in range(schema_drift.MAP_NAMES + 1)} | {"version": {"string"}}
    assert schema_drift._no_data(kinds, aliases) == {"version": {"string"}}
    assert ("a.b.c.d", "number") in set(schema_drift._paths({"a": {"b": {"c": {"d": 1}}}}, 4)) and (schema_drift.LEFT_OUT, "") in set(schema_drift._paths({"x/y": 1}, 1))


def test_names_beside_many_others_are_inferred(spark):
    """A new name counts beside any number of names that are data, at the root, below a listed parent and in objects named by ids."""
    many = {f"k{i}": i for i in range(schema_drift.MAP_NAMES + 1)}
    lines = [{"type": "a", "payload": {"cli_version": "1"}}, {"eventType": "a", "payload": {"clientVersion": "2"} | many} | many, {"eventType": "b", "payload": {k: {"v": 1} for k in many} | {"clientVersion": "3"}}]
    df = spark.createDataFrame([(i, i, "s", i, 0, json.dumps(x), "") for i, x in enumerate(lines, 1)], LINES)
    files = spark.createDataFrame([(k, "r", dt.datetime(2026, 1, k)) for k in (1, 2, 3)], "file_id long, source_root string, opened_at timestamp_ntz")
    v = "payload.cli_version"
    aliases = [(v, v), ("type", "type"), ("type", "event_type")]
    got = {(r.file_id, r.field_name, r.change, r.listed) for r in schema_drift.drift(df, files, aliases, stored).collect()}
    assert got == {(2, v, "removed", True), (2, v, "renamed", False), (2, "type", "removed", True), (2, "type", "renamed", False)}
    seen = stored(schema_drift.observed(df, schema_drift.depth_of(aliases)), "schemas")
    report = {r.path: r for r in schema_drift.report(seen, schema_drift.correspondences(seen, aliases)).collect()}
    assert report["payload.clientVersion"].field_name == v and report["payload.clientVersion"].files == 2 and report["eventType"].field_name == "type" and {"k7", "payload.k7"} < set(report)


def test_flooding_by_groups_selects_as_one_by_one(spark, monkeypatch):
    aliases = schema_drift.alias_list(table(spark, D, "field_aliases"))
    r = random.Random(11)
    words = ["version", "cliVersion", "type", "kind", "payload", "body", "entry", "client", "data", "clientVersion", "event", "build"]
    saved = 0
    for _ in range(100):
        some = {".".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20))}
        for _ in range(r.randrange(4)):  # names that are data, with and without objects below them
            below, end = r.choice(["", *(f"{p}." for p in some)]), r.choice(["", "_version", "Type", "x"])
            for k in range(r.randrange(50)):
                some |= {f"{below}{r.choice('abk')}{k}{end}"} | ({f"{below}k{k}{end}.{r.choice(words)}"} if r.random() < 0.3 else set())
        schema = with_parents({p: {r.choice(["string", "number", "array"])} for p in some})
        want = schema_drift.flood(schema, aliases)
        with monkeypatch.context() as m:
            m.setattr(schema_drift, "ONE_BY_ONE", 0)
            got = schema_drift.flood(schema, aliases)
        assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-9)
        left, up, _ = schema_drift._tree(schema)
        saved += len(left) - len(schema_drift._groups(left, up.tolist(), schema_drift._tree(p for _, p in aliases)[0], schema)[1])
    assert saved > 1000


def test_inferred_renames(spark):
    """Without the flooding, a lookup of listed paths would see neither the new name nor the rename."""
    line = lambda name, v: json.dumps({"type": "a", "payload": {name: v, "id": "x"}})
    lines = [(1, 1, line("cli_version", "1")), (2, 2, line("clientVersion", "2")), (3, 3, line("clientVersion", 3)), (4, 4, json.dumps({"type": "a", "payload": {"id": "x"}})), (5, 4, json.dumps({"x/y": 1, "": 2, "k": 3}))]
    df = spark.createDataFrame([(i, f, "s", i, 0, x, "") for i, f, x in lines], LINES)
    files = spark.createDataFrame([(k, "r", dt.datetime(2026, 1, k)) for k in (1, 2, 3, 4)], "file_id long, source_root string, opened_at timestamp_ntz")
    aliases = [("payload.cli_version", "payload.cli_version"), ("payload.cli_version", "payload.cliVersion"), ("type", "type")]
    got = {(r.file_id, r.field_name, r.change, r.listed) for r in schema_drift.drift(df, files, aliases, stored).collect()}
    v = "payload.cli_version"
    assert got == {(2, v, "removed", True), (2, v, "renamed", False), (3, v, "retyped", False), (4, v, "removed", False)}
    seen = stored(schema_drift.observed(df, schema_drift.depth_of(aliases)), "schemas")
    matched = schema_drift.correspondences(seen, aliases)
    report = {r.path: r for r in schema_drift.report(seen, matched).collect()}
    assert report[None].n == 2 and report["payload.clientVersion"].field_name == v and not report["payload.clientVersion"].listed and report["payload.clientVersion"].types == ["number", "string"]
    rows = schema_drift.united(df, [("s", r.path, r.field_name, "double" if r.field_name == v else "string") for r in matched.collect()]).orderBy("line_id").collect()
    assert [r.payload_cli_version for r in rows] == [1.0, 2.0, 3.0, None, None] and rows[1].payload_cli_version_path == "payload.clientVersion" and rows[2].payload_cli_version_type == "number"
    assert schema_drift.common_type({"number"}) == "double" and schema_drift.common_type({"number", "string"}) == "string"


def test_a_root_of_one_day(spark, monkeypatch):
    """All files of a root opened at one time, or at none, are put in order in parts."""
    monkeypatch.setattr("loomlog.operators.ordered.CHUNK", 7)
    n = 100
    df = spark.createDataFrame([(i, i, "s", 1, 0, json.dumps({"version": "1"} if i % 3 else {"version": 1}), "") for i in range(n)], LINES)
    files = spark.createDataFrame([(i, "r", None if i < 50 else dt.datetime(2026, 1, 1)) for i in range(n)], "file_id long, source_root string, opened_at timestamp_ntz")
    got = {(r.file_id, r.change) for r in schema_drift.drift(df, files, [("version", "version")], stored).collect()}
    assert got == {(i, "retyped") for i in range(1, n) if (i % 3 == 0) != ((i - 1) % 3 == 0)}


def test_drift_edge_cases(spark):
    lines = [(1, 1, '{"version": "1"}'), (2, 2, "broken"), (3, 3, '{"cliVersion": 2, "version": null}'), (4, 4, "{}"), (5, None, '{"version": 1}'), (6, 5, '{"version": {"a": [1]}, "client.version": 3}'), (7, 9, '{"version": 1}')]
    df = spark.createDataFrame([(i, f, None, i, 0, x, "") for i, f, x in lines], LINES)
    files = spark.createDataFrame([(k, "r", dt.datetime(2026, 1, d)) for k, d in ((1, 1), (2, 2), (3, 3), (4, 9), (5, 8))] + [(6, None, None)], "file_id long, source_root string, opened_at timestamp_ntz")
    aliases = [("version", "version"), ("version", "cliVersion"), ("version", "client.version")]
    got = {(r.file_id, r.change) for r in schema_drift.drift(df, files, aliases, stored).collect()}
    assert got == {(3, "renamed"), (3, "retyped"), (5, "renamed"), (5, "retyped"), (4, "removed")}
    assert schema_drift.drift(df.where("false"), files, aliases, stored).count() == 0


def test_united_table(spark):
    row = general.p1_table(spark, D)
    assert row.count() == sum(load_object(r.raw_line) is not None for r in table(spark, D, "session_lines").collect())
    assert {"version", "version_type", "version_path", "payload_cli_version"} <= set(row.columns)


def test_children(spark):
    line = {
        "message": {"content": [None, {"type": "tool_result", "content": [{"type": "text"}, None, "plain"]}, {"type": 3}, "s", {"type": "tool_result", "content": ""}]},
        "snapshot": {"trackedFileBackups": {"b": {"v": 1}, "Ä": {"v": 1}, "a": None, "B": 5}},
        "messages": [{"toolCalls": [{"name": "x"}, None]}, 7, {"toolCalls": [{"id": 1}]}],
        "todos": {"todos": [None, {"content": "do"}]},
    }
    rows = [tuple(r[:4]) for r in nested.nodes(line) if r[0] in nested.CHILD_TABLES]
    assert sorted(rows) == sorted([
        ("result_block", 1, 0, "text"), ("result_block", 1, 2, "text"), ("content_block", 0, 1, "tool_result"), ("content_block", 0, 2, ""), ("content_block", 0, 3, "text"), ("content_block", 0, 4, "tool_result"),
        ("tracked_file", 0, 0, "B"), ("tracked_file", 0, 2, "b"), ("tracked_file", 0, 3, "Ä"), ("tool_call", 0, 0, "x"), ("tool_call", 2, 0, ""), ("todo", 0, 1, "do"),
    ])
    texts = [json.dumps(line), json.dumps({"message": {"content": "hi"}}), json.dumps({"message": {"content": ""}}), json.dumps({"message": {"content": {"type": "t"}}}), "[1]", "", None, "{}", json.dumps(line), '{"a":' * 2000 + "1" + "}" * 2000, '{"message":{"content":"\\ud800"}}']
    df = spark.createDataFrame(line_rows(texts), LINES)
    got = [tuple(r) for r in nested.occurrences(df).collect()]
    assert len(got) == 2 * 12 + 3 and (1, "content_block", 0, 0, "text") in got and (3, "content_block", 0, 0, "t") in got
    rows = nested.bridge(df).collect()
    assert len({(r.line_id, r.at) for r in rows}) == len(rows)
    by_at = {(r.line_id, r.at): r for r in rows}
    assert all(by_at[r.line_id, r.parent_at].node == r.parent for r in rows if r.parent_at is not None)
    bridge = {(r.line_id, r.child_table, r.parent_pos, r.pos): r for r in rows if r.child_table != "object"}
    assert bridge[0, "result_block", 1, 0].parent == bridge[0, "content_block", 0, 1].node and by_at[0, bridge[0, "content_block", 0, 1].parent_at].label == "/message"
    assert bridge[0, "", 0, 0].node == bridge[8, "", 0, 0].node and bridge[0, "tracked_file", 0, 2].node == bridge[0, "tracked_file", 0, 3].node
    stored_once = {r.node: r for r in nested.objects(df).collect()}
    assert stored_once[bridge[0, "", 0, 0].node].occurrences == 2 and sum(r.occurrences for r in stored_once.values()) == len(rows)
    assert nested.whole(bridge[0, "", 0, 0].node, lambda n: stored_once[n].body)["todos"] == line["todos"]


EXACT = [
    '{"a":1.10,"b":12345678901234567890.123,"c":1e400,"d":-0,"e":1E+2}', '{"x":[{"y":{"z":1}},{"y":{"z":1}}],"w":{"y":{"z":1}}}', '{"$node":"abc","a":{"$node":"abc"},"b":[{"$node":{"$node":1}}]}', '{"a":1,"a":{"b":2},"a":{"b":2}}',
    '{"message":{"content":"x","content":"y"}}', '{"message":{"content":[{"type":"tool_result","content":"r","content":[null,{"a":1}]},"s",1.50,[{"k":{}}],null]}}', '{"snapshot":{"trackedFileBackups":{"a/b":{},"~":1,"a/b":[]}}}', '{"a":"\\ud800 \\u0000 é"}', "{}", '{"":{"":{}}}',
]


def plain(x):
    if isinstance(x, dict):
        return ("object", sorted(((k, plain(v)) for k, v in nested._slots(x)), key=lambda p: p[0]))
    return ("array", [plain(v) for v in x]) if isinstance(x, list) else (type(x).__name__, x)


def test_lines_come_back_exactly(spark):
    lines = table(spark, D, "session_lines").select("line_id", "raw_line")
    texts = {r.line_id: r.raw_line for r in lines.collect()} | {-i - 1: x for i, x in enumerate(EXACT)}
    df = spark.createDataFrame(list(texts.items()), "line_id long, raw_line string")
    bodies = {r.node: r.body for r in nested.objects(df).collect()}
    tops = {r.line_id: r.node for r in nested.bridge(df).where("child_table = ''").collect()}
    values = {i: v for i, x in texts.items() if (v := load_object(x, all_names=True)) is not None}
    assert set(tops) == set(values)
    for i, v in values.items():
        assert plain(nested.whole(tops[i], bodies.get)) == plain(v)
    same = [r for r in nested.nodes(load_object(EXACT[1], all_names=True)) if r[8] == '{"z":1}']
    assert len(same) == 3 and len({r[4] for r in same}) == 1 and {r[3] for r in same} == {"/y"}
    assert [r[3] for r in nested.nodes(load_object('{"message":{"content":"x","content":"x"}}', all_names=True)) if r[0] == "content_block"] == ["text"]
    deep = '{"a":' * 2500 + "1.0" + "}" * 2500
    rows = nested.nodes(load_object(deep, all_names=True))
    assert len(rows) == 2500 and rows[-1][8] == '{"a":1.0}'


@pytest.mark.parametrize("raw, zone, want", [
    ("2025-12-13T22:49:11.691Z", "Asia/Kolkata", "2025-12-13T22:49:11.691"), ("2025-12-13T15:45:03.871119", "America/Los_Angeles", "2025-12-13T23:45:03.871119"), ("2025-12-13 14:59", None, "2025-12-13T14:59:00"),
    ("1765666914", "Asia/Kolkata", "2025-12-13T23:01:54"), ("1765671357092", None, "2025-12-14T00:15:57.092"), ("1765674835130427886", None, "2025-12-14T01:13:55.130427"), ("1.765666486822131E9", None, "2025-12-13T22:54:46.822131"),
    ("2025/12/13 15:39:25", "UTC", "2025-12-13T15:39:25"), ("20251213T225042Z", "UTC", "2025-12-13T22:50:42"), ("2025-12-13T23:51:53.938569951Z", "UTC", "2025-12-13T23:51:53.938569"), ("2026-07-29T18:07:03,012+0800", "UTC", "2026-07-29T10:07:03.012"),
    ("2025-12-13 23:41:45+00", "Asia/Kolkata", "2025-12-13T23:41:45"), ("2025-12-13T15:12:39-08:00[America/Los_Angeles]", None, "2025-12-13T23:12:39"), ("2025-05-02 04:40:11z", "Europe/London", "2025-05-02T04:40:11"),
    ("2025-04-06 08:24:46 PDT", "America/New_York", "2025-04-06T15:24:46"), ("Dec 13, 2025 3:18:19 PM", "America/Los_Angeles", "2025-12-13T23:18:19"), ("Mar 31, 2026 12:14:26 AM", "UTC", "2026-03-31T00:14:26"),
    ("Tue, 8 Sep 2026 23:50:19 +0100", None, "2026-09-08T22:50:19"), ("2026-03-08 02:47:52.876", "America/New_York", "2026-03-08T07:47:52.876"), ("2025-11-02 01:30:00", "America/New_York", "2025-11-02T05:30:00"),
    ("  2025-12-13 15:49:41.236848 ", "UTC", "2025-12-13T15:49:41.236848"), ("2025-01-01 00:00", "No/Where", "2025-01-01T00:00:00"), ("2025-06-01 10:00:00 Europe/Berlin", None, "2025-06-01T08:00:00"),
    *[(x, "UTC", None) for x in ("", " ", None, "null", "T10:00:00Z", "2026-05-05T25:10:00Z", "2025-13-04T01:02:03Z", "2025-02-30 10:00:00", "yesterday 09:00", "in 5 min", "-", "12", "17656669141", "2025-01-01 10:00:60", "2025-01-01T24:00:00Z", "1e400", "9" * 300, "2025-01-01 10:00:00 Nowhere", "0000-01-01 00:00:00")],
])
def test_instants(raw, zone, want):
    got = instants.parse(raw, zone)
    assert got == (None if want is None else int((dt.datetime.fromisoformat(want) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)))


def test_dictionary_grows(spark):
    first = spark.createDataFrame([("1765666914", None), ("1765666914", "UTC"), ("x", None), (None, "UTC")], "raw string, zone string")
    known = instants.dictionary(first, stored)
    assert known.count() == 2
    grown = instants.dictionary(first.unionByName(spark.createDataFrame([("2025-01-01 00:00", "UTC")], "raw string, zone string")), stored, known)
    assert grown.count() == 3 and grown.where("instant_us is null").count() == 1


@pytest.mark.parametrize("raw, want", [("1765666914." + "9" * 60, 1765666914_999999), ("1765666914" + "9" * 9 + "." + "9" * 500, 1765666914_999999), (" " * 300 + "2025-12-13T23:51:53." + "9" * 400 + "Z", 1765669913_999999), ("1" * 100_000, None), ("x" * 100_000, None)])
def test_instants_of_long_texts(raw, want):
    assert instants.parse(raw) == want


def test_the_dictionary_is_kept(spark, tmp_path, monkeypatch):
    """A second run over the same texts parses nothing, another run only what is new."""
    from loomlog.plans.store import Store

    spark.conf.set(general.DICTIONARY, str(tmp_path / "journal"))
    try:
        first = {tuple(r) for r in general.p6_found(spark, D).collect()}
        held = Store(spark, str(tmp_path / "journal")).table("instants").count()
        assert {tuple(r) for r in general.p6_found(spark, D).collect()} == first
        store = Store(spark, str(tmp_path / "journal"))
        assert store.table("instants").count() == held and len(store.state()["tables"]["instants"]) == 1
        assert general.remembered(store, spark.createDataFrame([("2020-01-01 00:00", None)], "raw string, zone string")).count() == held + 1
        assert store.check() == []
    finally:
        spark.conf.unset(general.DICTIONARY)
    assert {tuple(r) for r in general.p6_found(spark, D).collect()} == first


def test_all_instants(spark):
    zones = {r.file_id: r.tz_name for r in table(spark, D, "source_files").collect()}
    want = set()
    for name, key, column in (("chat_messages", "row_id", "event_ts"), ("sessions", "session_id", "started_at"), ("store_sessions", "row_id", "time_created")):
        want |= {(name, r[key], x) for r in table(spark, D, name).collect() if (x := instants.parse(r[column], r.tz_name)) is not None}
    for r in table(spark, D, "session_lines").collect():
        value = load_object(r.raw_line, raw_numbers=True)
        at = ((value or {}).get("payload") or {}).get("started_at") if value and isinstance(value.get("payload"), dict) else None
        if isinstance(at, str) and (x := instants.parse(at, zones.get(r.file_id))) is not None:
            want.add(("session_lines", r.line_id, x))
    assert {tuple(r) for r in general.p6_found(spark, D).collect()} == want


def test_extra_and_clashing_columns(spark):
    lines = table(spark, D, "session_lines").withColumns({"path": F.lit(1), "type": F.lit(2), "reason": F.lit("x"), "body": F.lit("b"), "node": F.lit("n"), "at": F.lit(0)})
    assert nested.occurrences(lines).count() == general.p4_found(spark, D).count()
    assert parse_failures.rejected_lines(lines).count() == general.p2_found(spark, D).where("origin = 'session_lines'").count()


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    """The tables without rows, but for the fixed one."""
    import glob
    import os

    import pyarrow.parquet as pq

    folder = str(tmp_path_factory.mktemp("empty"))
    for f in glob.glob(f"{D}/*.parquet"):
        rows = pq.read_table(f)
        pq.write_table(rows if "field_aliases" in f else rows.slice(0, 0), f"{folder}/{os.path.basename(f)}")
    return folder


@pytest.mark.parametrize("name", sorted(general.QUERIES))
def test_empty_tables(spark, empty, name):
    assert general.QUERIES[name](spark, empty).collect() == []
