"""Labelled preference examples from session events: parse, merge streams, file timelines, labels, status and export.

An event line holds snapshots of files, proposals of tools, or their results. Streams of a session and its subagents are merged by
time and renumbered; snapshots become the timeline of each file; each proposal that can change files is labelled by whether its
effect is still in the file's last state. Lines that are no JSON object give an error row and don't stop the session. Null
contents count as missing; empty sessions give nothing; keys of any size are handled in chunks (see ordered).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions import text
from loomlog.functions.strictjson import load_object
from loomlog.operators import ordered

#: Version, length of the context, and the words by which a result tells a denial: fixed values.
VERSION = "taste-1"
PRIOR_EVENTS = 5
DENIAL = "new_string was NOT written"
KEYS = ["source", "source_session_id"]
PARSED = (
    "source string, source_session_id string, stream_idx int, agent_id string, line_seq long, block_idx int, ts string, kind string,"
    " file_path string, content string, sidecar_name string, sidecar_version long, tool_ref string, tool_name string"
)


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _get(value, *names):
    for n in names:
        value = value.get(n) if isinstance(value, dict) else None
    return value


def _first_present(value, *names):
    """The value of the first name that is there, whatever it is."""
    if isinstance(value, dict):
        for n in names:
            if n in value:
                return value[n]
    return None


def _proposed(tool: str | None, given) -> str | None:
    if tool == "Edit":
        return _text(_get(given, "new_string"))
    if tool in ("Write", "NotebookEdit"):
        return _text(_first_present(given, "content", "new_source"))
    if tool == "Bash":
        return _text(_get(given, "command"))
    if tool and tool.startswith("mcp_"):
        inline = _text(_get(given, "new_string"))
        return _text(_get(given, "content")) if inline is None else inline
    return None


def _result(block: dict) -> str | None:
    content = block.get("content")
    if isinstance(content, str):
        return content
    parts = [t for item in content if (t := _text(_get(item, "text"))) is not None] if isinstance(content, list) else []
    return "\n".join(parts) if parts else None


def events_of_line(line: str | None) -> list[dict]:
    """The parsed events of one line, in order; one of kind 'error' where it is no JSON object."""
    value = load_object(line)
    if value is None:
        return [{"kind": "error"}]
    ts = _text(value.get("timestamp"))
    ts = _text(_get(value, "snapshot", "timestamp")) if ts is None else ts
    kind, found = value.get("type"), []
    if kind == "file-history-snapshot":
        backups = _get(value, "snapshot", "trackedFileBackups")
        entries = [(_get(e, "filePath"), e, True) for e in backups] if isinstance(backups, list) else []
        if isinstance(backups, dict):
            entries = [(k, backups[k], False) for k in sorted(backups, key=lambda k: k.encode("utf-8", "surrogatepass"))]
        for path, entry, inline in entries:
            if not isinstance(path, str):
                continue
            own = _text(_get(entry, "timestamp" if inline else "backupTime"))
            row = {"kind": "file_snapshot", "ts": ts if own is None else own, "file_path": path}
            if inline:
                row["content"] = _text(_get(entry, "content"))
            else:
                version = _get(entry, "version")
                row["sidecar_name"] = _text(_get(entry, "backupFileName"))
                row["sidecar_version"] = version if isinstance(version, int) and not isinstance(version, bool) and version >= 0 else None
            found.append(row)
        return found
    blocks = _get(value, "message", "content")
    for block in blocks if isinstance(blocks, list) and kind in ("assistant", "user") else []:
        if kind == "assistant" and _get(block, "type") == "tool_use":
            given, tool = block.get("input"), _text(block.get("name"))
            path = _text(_first_present(given, "file_path", "path", "notebook_path"))
            found.append({"kind": "tool_proposal", "ts": ts, "file_path": path, "content": _proposed(tool, given), "tool_ref": _text(block.get("id")), "tool_name": tool})
        elif kind == "user" and _get(block, "type") == "tool_result":
            said = _result(block)
            denied = said is not None and DENIAL in said
            found.append({"kind": "permission_denial" if denied else "tool_result", "ts": ts, "content": said, "tool_ref": _text(block.get("tool_use_id"))})
    return found


def parse(lines: DataFrame) -> DataFrame:
    """Parsed events of lines (source, source_session_id, stream_idx, agent_id, line_seq, payload)."""
    names = [x.strip().split()[0] for x in PARSED.split(",")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[x.strip().split()[1]] for x in PARSED.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for *own, payload in zip(*(c.to_pylist() for c in batch.columns)):
                for i, event in enumerate(events_of_line(payload)):
                    row = dict(zip(names, [*own, i])) | event
                    for column, n in zip(out, names):
                        column.append(row.get(n))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return lines.select(*KEYS, "stream_idx", "agent_id", "line_seq", "payload").mapInArrow(run, PARSED)


def merge_streams(parsed: DataFrame, keep) -> DataFrame:
    """One numbered stream per session: by time as text (missing first), line, stream and block."""
    order = [F.coalesce("ts", F.lit("")), F.col("line_seq"), F.col("stream_idx"), F.col("block_idx")]
    return ordered.numbered(parsed.where("kind <> 'error'"), KEYS, order, "seq", keep)


def with_paths(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The events with file paths relative to their session's cwd (source, source_session_id, cwd)."""
    cwds = sessions.select(*KEYS, "cwd")
    return events.join(cwds, KEYS, "left").withColumn("file_path", text.normalize_path(F.col("file_path"), F.col("cwd")))


def timelines(events: DataFrame, blobs: DataFrame) -> DataFrame:
    """(source, source_session_id, file_path, seq, event_seq, content, trigger_event_ref, source_kind) of all kept snapshots.

    events: merged, with_paths; blobs: (source_session_id, backup_name, blob). The trigger is the last proposal for the file."""
    on_files = events.where("(kind = 'tool_proposal' and file_path is not null and tool_ref is not null) or (kind = 'file_snapshot' and file_path is not null and (content is not null or sidecar_name is not null))")
    group = [*KEYS, "file_path"]
    with_trigger = ordered.last_before(on_files, group, "seq", F.when(F.col("kind") == "tool_proposal", F.col("tool_ref")), "trigger_event_ref")
    snapshot = F.col("kind") == "file_snapshot"
    counted = ordered.count_before(with_trigger, group, "seq", snapshot, "file_seq").where(snapshot)
    named = blobs.select("source_session_id", F.col("backup_name").alias("sidecar_name"), "blob")
    rows = counted.join(named, ["source_session_id", "sidecar_name"], "left")
    inline = F.col("content").isNotNull()
    return rows.select(
        *group, F.col("file_seq").alias("seq"), F.col("seq").alias("event_seq"), F.coalesce("content", "blob").alias("content"), "trigger_event_ref",
        F.when(inline, "inline_snapshot").when(F.col("blob").isNotNull(), "sidecar_snapshot").otherwise("missing_sidecar").alias("source_kind"),
    )


def final_states(timeline: DataFrame) -> DataFrame:
    """The content of the last row of each file, null where that row has none."""
    return timeline.groupBy(*KEYS, "file_path").agg(F.max_by(F.struct("content"), "seq")["content"].alias("final"))


def first_by_trigger(timeline: DataFrame) -> DataFrame:
    return (
        timeline.where("trigger_event_ref is not null")
        .groupBy(*KEYS, "file_path", F.col("trigger_event_ref").alias("tool_ref"))
        .agg(F.min_by(F.struct("content"), "seq").alias("applied"))
    )


def around(proposals: DataFrame, timeline: DataFrame) -> DataFrame:
    """The proposals with the states of their file before and after them, as structs: found and null is not the same as not found.

    Only the numbers of the states go through the windows; their contents are fetched once for each."""
    group = [*KEYS, "file_path"]
    both = proposals.where("file_path is not null").select(*group, "seq", F.lit(None).cast("long").alias("state")).unionByName(timeline.select(*group, F.col("event_seq").alias("seq"), F.col("seq").alias("state")))
    seen = ordered.last_before(both, group, "seq", F.col("state"), "before_state")
    seen = ordered.next_after(seen, group, "seq", F.col("state"), "later_state").where("state is null").select(*group, "seq", "before_state", "later_state")
    found = proposals.join(seen, [*group, "seq"], "left")
    for name in ("before", "later"):
        contents = timeline.select(*group, F.col("seq").alias(f"{name}_state"), F.struct("content").alias(name))
        found = found.join(contents, [*group, f"{name}_state"], "left")
    return found.drop("before_state", "later_state")


def prior_lines(events: DataFrame, proposals: DataFrame) -> DataFrame:
    """(source, source_session_id, seq, prior): the last events before each proposal, snapshots left out."""
    spoken = events.where("kind <> 'file_snapshot'")
    said = F.format_string("[seq=%d %s %s%s]", "seq", "kind", F.coalesce(F.when(F.col("kind") == "tool_proposal", F.col("tool_name")).otherwise(F.col("tool_ref")), F.lit("unknown")),
                           F.when((F.col("kind") == "tool_proposal") & F.col("raw_path").isNotNull(), F.concat(F.lit(" "), F.col("raw_path"))).otherwise(""))
    ranked = ordered.count_before(spoken.select(*KEYS, "seq", said.alias("line")), KEYS, "seq", F.lit(True), "nth")
    lines = ordered.values_before(ranked, KEYS, "nth", F.col("line"), PRIOR_EVENTS, "lines").where(F.size("lines") > 0)
    return lines.join(proposals.select(*KEYS, "seq"), [*KEYS, "seq"], "left_semi").select(*KEYS, "seq", F.array_join("lines", "\n").alias("prior"))


def compile_examples(events: DataFrame, timeline: DataFrame, keep) -> DataFrame:
    """The labelled examples. events: merged, with the path as written in raw_path and the normal one in file_path, and cwd."""
    proposals = events.where((F.col("kind") == "tool_proposal") & F.col("tool_ref").isNotNull() & text.is_file_modifying(F.col("tool_name")))
    guessed = text.normalize_path(text.bash_target(F.col("content")), F.col("cwd"))
    proposals = proposals.withColumn("file_path", F.coalesce("file_path", guessed))
    proposals = ordered.count_before(proposals, KEYS, "seq", F.lit(True), "generation").select(*KEYS, "generation", "seq", "tool_ref", "file_path", "tool_name", "content")
    proposals = keep(proposals, "proposals")
    refs = lambda kind, name: events.where((F.col("kind") == kind) & F.col("tool_ref").isNotNull()).select(*KEYS, "tool_ref").distinct().withColumn(name, F.lit(True))
    group = [*KEYS, "file_path"]
    rows = (
        around(proposals, timeline)
        .join(first_by_trigger(timeline), [*group, "tool_ref"], "left")
        .join(final_states(timeline).withColumn("tracked", F.lit(True)), group, "left")
        .join(refs("permission_denial", "denied"), [*KEYS, "tool_ref"], "left")
        .join(refs("tool_result", "executed"), [*KEYS, "tool_ref"], "left")
        .join(prior_lines(events, proposals), [*KEYS, "seq"], "left")
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    correlated = (F.col("tool_name") == "Bash") | F.startswith(F.col("tool_name"), F.lit("mcp_"))
    post = F.when(F.col("applied").isNotNull(), F.col("applied.content")).when(correlated, F.col("later.content"))
    label = text.classify(F.col("tool_name"), F.col("file_path"), flag("denied"), flag("executed"), flag("tracked"), F.col("before.content"), post, F.col("final"))
    context = F.when(F.col("prior").isNull(), F.col("before.content")).otherwise(F.concat(F.lit("--- prior events ---\n"), "prior", F.lit("\n\n--- file before ---\n"), F.col("before.content")))
    return rows.withColumn("label", label).select(
        *KEYS, "generation", F.col("seq").alias("proposal_event_seq"), F.col("tool_ref").alias("tool_use_id"), "file_path", "tool_name", F.col("content").alias("proposal_content"),
        context.alias("context"), "label.*", F.lit(VERSION).alias("extractor_version"),
    )


def extract(lines: DataFrame, sessions: DataFrame, blobs: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """(timelines, examples) of all sessions in one job."""
    merged = merge_streams(keep(parse(lines), "parsed"), keep).withColumn("raw_path", F.col("file_path"))
    events = keep(with_paths(merged, sessions), "events")
    timeline = keep(timelines(events, blobs), "timelines")
    return timeline, compile_examples(events, timeline, keep)


def pending(sessions: DataFrame, done: DataFrame, version: str = VERSION, force: bool = False) -> DataFrame:
    """The sessions whose examples are missing or were compiled by another version or from another number of events."""
    if force:
        return sessions
    same = done.where(F.col("extractor_version") == version).select(*KEYS, F.col("event_count").alias("done_count"))
    return sessions.join(same, KEYS, "left").where(~F.col("event_count").eqNullSafe(F.col("done_count")) | F.col("done_count").isNull()).drop("done_count")


def status(examples: DataFrame) -> DataFrame:
    """One row: examples by outcome and evidence, and the share of high confidence in percent (0 without examples)."""
    total, high = F.count(F.lit(1)), F.count_if(F.col("confidence") >= 1.0)
    return examples.agg(
        total.alias("examples"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("accepted", "rejected", "edited")],
        high.alias("high_confidence"),
        F.when(total == 0, F.lit(0.0)).otherwise(high / total * 100).alias("high_percent"),
        *[F.count_if(F.col("evidence_kind") == k).alias(k) for k in ("direct_edit", "direct_write", "bash_correlation", "mcp_correlation", "permission_denial", "missing_final_state")],
    )


def triples(examples: DataFrame) -> DataFrame:
    """(context, chosen, rejected) beside each example's key: accepted and edited proposals are chosen."""
    good = F.col("outcome").isin("accepted", "edited")
    return examples.select(*KEYS, "generation", "proposal_event_seq", "context", F.when(good, F.col("proposal_content")).alias("chosen"), F.when(~good, F.col("proposal_content")).alias("rejected"))


def export(examples: DataFrame, path: str) -> None:
    """JSON lines in the order of the keys, nulls kept, into a new folder only."""
    ordered_rows = triples(examples).orderBy(*KEYS, "generation", "proposal_event_seq")
    ordered_rows.select(F.to_json(F.struct(*ordered_rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def found_or_none(rows: DataFrame, what: Column):
    """Exactly one row that meets the condition: LookupError where there is none or more than one."""
    got = rows.where(what).limit(2).collect()
    if len(got) != 1:
        raise LookupError("not found" if not got else "ambiguous")
    return got[0]
