"""What stands in session files, byte by byte: headers, committed lines with their offsets, chat messages, side files.

Contents are read on the executors, at most as many bytes as the listing saw: the first bytes for the header, the whole file once as a stream
for its hashes, and of its lines only the ranges that are imported. A line is committed once its \\n is written; the rest waits.
A blank or broken line, or one whose header fields have wrong types, stops its file: later lines wait until it is mended.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.strictjson import loads
from loomlog.operators.nested import canonical

#: A header line is looked for in so many bytes: a fixed value.
HEADER_BYTES = 64 * 1024
#: Files are read in blocks; lines are imported in ranges of about RANGE_BYTES, one task each.
BLOCK_BYTES = 1 << 20
RANGE_BYTES = 32 << 20
HEADERS = "path string, error_kind string, message string, header_id string"
FACTS = (
    "path string, error_kind string, message string, fingerprint string, committed long, committed_fingerprint string, prefix_intact boolean, marks string, metadata string,"
    " meta_cwd string, meta_started string, meta_ended string"
)
LINES = "path string, seq long, byte_offset long, end_offset long, ts string, cwd string, payload binary, error_kind string, message string"


def opened(path: str):
    """A file to be read, on a mounted or, given with its scheme, any other file system that Arrow knows."""
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return open(path, "rb")


def read_bounded(path: str, size: int | None, start: int = 0) -> bytes:
    """A file's bytes from start up to size."""
    with opened(path) as file:
        if start:
            file.seek(start)
        return file.read() if size is None else file.read(max(0, size - start))


def blocks(path: str, size: int) -> Iterator[bytes]:
    with opened(path) as file:
        left = size
        while left > 0 and (block := file.read(min(BLOCK_BYTES, left))):
            left -= len(block)
            yield block


def modified(path: str) -> int | None:
    """When a file was changed, in whole seconds."""
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        changed = system.get_file_info(at).mtime_ns
        return None if changed is None else changed // 1_000_000_000
    return int(os.stat(path).st_mtime)


def fingerprint(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def committed(data: bytes) -> int:
    """The length up to the last line end."""
    return data.rfind(b"\n") + 1


class BadHeader(ValueError):
    """A file that doesn't begin as its tool's files do."""


def _header(data: bytes, what: str) -> dict | None:
    """The object of the first committed line; None where the line is longer than HEADER_BYTES."""
    end = data.find(b"\n", 0, HEADER_BYTES)
    if end < 0:
        if len(data) >= HEADER_BYTES:
            return None
        raise BadHeader(f"{what}: no committed header line")
    try:
        value = loads(data[:end].decode("utf-8"))
    except ValueError as error:
        raise BadHeader(f"{what}: {error}") from None
    if not isinstance(value, dict):
        raise BadHeader(f"{what}: the header is no object")
    return value


def _named(value, what: str) -> str:
    if not isinstance(value, str) or not value:
        raise BadHeader(f"{what}: the id is missing")
    return value


def resolve_id(kind: str, data: bytes, own: str) -> str:
    """The session's id by the rule of its kind; own is what the path gave."""
    if kind == "known":
        return own
    if kind == "gemini_chat":
        try:
            value = loads(data.decode("utf-8"))
        except ValueError as error:
            raise BadHeader(f"chat: {error}") from None
        if not isinstance(value, dict) or not isinstance(value.get("messages"), list) or not _named(value.get("sessionId"), "chat").strip():
            raise BadHeader("chat: no session")
        return value["sessionId"]
    head = _header(data, kind)
    if head is None:
        if kind == "local_agent_header":
            return own
        raise BadHeader(f"{kind}: the header line is too long")
    if kind == "local_agent_header":
        return _named(head.get("session_id", head.get("sessionId")), kind)
    if kind == "codex_header":
        if head.get("type") == "session_meta":
            payload = head.get("payload")
            return _named(payload.get("id") if isinstance(payload, dict) else None, kind)
        old = head.get("id")
        if head.get("type") is None and isinstance(old, str) and isinstance(head.get("timestamp"), str) and _is_uuid(old):
            return old
        raise BadHeader(f"{kind}: neither a session nor an old header")
    wanted = {"factory_header": "session_start", "pi_header": "session"}[kind]
    if head.get("type") != wanted:
        raise BadHeader(f"{kind}: the file doesn't begin with {wanted}")
    return _named(head.get("id"), kind)


def _is_uuid(text: str) -> bool:
    return len(text) == 36 and all((c == "-") == (i in (8, 13, 18, 23)) and (c == "-" or c in "0123456789abcdefABCDEF") for i, c in enumerate(text))


def _moment(value) -> str | None:
    """A time of a side file: text as it is, numbers as ISO text (ten digits and more: milliseconds)."""
    import datetime as dt

    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        return value
    ms = int(value if abs(value) >= 1e10 else value * 1000)
    at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03}Z"


def side_file(source: str, path: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(metadata, cwd, started, ended) of a session's side file; all None where there is none."""
    if path is None:
        return None, None, None, None
    try:
        data = read_bounded(path, None)
    except OSError:
        return None, None, None, None
    try:
        value, error = loads(data.decode("utf-8")), None
    except ValueError as e:
        value, error = None, str(e)
    if source == "factory":
        return canonical({"path": path, "size": len(data), "mtime": modified(path), "fingerprint": fingerprint(data), "settings": value, "parse_error": error}), None, None, None
    value = value if isinstance(value, dict) else {}
    first = lambda *names: next((value[n] for n in names if value.get(n) is not None), None)
    cwd = first("cwd", "workspace_path", "workspacePath", "project_path", "projectPath")
    began, ended = first("started_at", "startedAt", "created_at", "createdAt"), first("ended_at", "endedAt", "updated_at", "updatedAt", "last_activity_at", "lastActivityAt")
    return None, cwd if isinstance(cwd, str) else None, _moment(began), _moment(ended)


def headers(files: DataFrame) -> DataFrame:
    """HEADERS of files (source, id_kind, source_session_id, format, path, size): the ids that stand in them, from their first bytes."""

    def one(source, kind, own, form, path, size):
        try:
            data = read_bounded(path, size if form == "json" else min(size, HEADER_BYTES))
        except IsADirectoryError:
            return path, "not_file", "no file", None
        except OSError as error:
            return path, "read_error", str(error.strerror or error), None
        if source == "codex_cli" and not data:
            return path, None, None, None
        try:
            found = resolve_id(kind, data, own)
            if source == "pi_agent" and kind == "known" and resolve_id("pi_header", data, own) != own:
                raise BadHeader("the header's id isn't the name's")
        except (BadHeader, UnicodeDecodeError) as error:
            return path, "invalid_session_meta", str(error), None
        return path, None, None, found

    return files.select("source", "id_kind", "source_session_id", "format", "path", "size").mapInArrow(_rows_of(one, HEADERS, many=False), HEADERS)


def scan(path: str, size: int, consumed: int, prefix: str | None) -> tuple:
    """(fingerprint, committed, fingerprint of what is committed, whether the consumed bytes are the same, marks), in one pass over the file.

    marks: places at line begins with the number of lines before them, the first 0, then one after each RANGE_BYTES, and where the consumed bytes end."""
    digest, done, lines, end, at_end, intact = hashlib.sha256(), 0, 0, 0, hashlib.sha256().hexdigest(), consumed == 0
    marks, last = [[0, 0]], b"\n"
    for block in blocks(path, size):
        cut = {block.rfind(b"\n") + 1, len(block)}
        if done < consumed <= done + len(block):
            cut.add(consumed - done)
        at = 0
        for stop in sorted(cut - {0}):
            part = block[at:stop]
            digest.update(part)
            at, lines, last = stop, lines + part.count(b"\n"), part[-1:]
            if last == b"\n":
                end, at_end = done + stop, digest.hexdigest()
            if done + stop == consumed:
                intact = digest.hexdigest() == prefix if prefix is not None else last == b"\n"
            if last == b"\n" and (done + stop == consumed or done + stop - marks[-1][0] >= RANGE_BYTES):
                marks.append([done + stop, lines])
        done += len(block)
    return digest.hexdigest(), end, at_end, intact, marks


def facts(files: DataFrame) -> DataFrame:
    """FACTS of files (source, metadata_path, format, path, size, next_read_offset, prefix_fingerprint)."""

    def one(source, metadata_path, form, path, size, offset, prefix):
        try:
            whole, end, at_end, intact, marks = scan(path, size, offset or 0, prefix)
        except IsADirectoryError:
            return (path, "not_file", "no file", *[None] * 9)
        except OSError as error:
            return (path, "read_error", str(error.strerror or error), *[None] * 9)
        if form == "json":
            end, at_end, marks = size, whole, [[0, 0]]
        return (path, None, None, whole, end, at_end, intact, json.dumps(marks), *side_file(source, metadata_path))

    return files.select("source", "metadata_path", "format", "path", "size", "next_read_offset", "prefix_fingerprint").mapInArrow(_rows_of(one, FACTS, many=False), FACTS)


def _rows_of(one, schema: str, many: bool = True):
    """A function over Arrow batches from one over rows."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*((x.split()[0], kinds[x.split()[1]]) for x in schema.split(",")))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), types)], names=list(names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if not many:
                    rows.append(one(*values))
                    continue
                for row in one(*values):
                    rows.append(row)
                    if len(rows) >= 2_000:
                        yield batch_of(rows)
                        rows = []
            yield batch_of(rows)

    return run


def _field(value, name: str, kind: type):
    inner = value.get(name)
    if inner is not None and not isinstance(inner, kind):
        raise ValueError(f"{name} is no {'object' if kind is dict else 'text'}")
    return inner


def event_header(source: str, line: bytes) -> tuple[str | None, str | None]:
    """(time as text, cwd) of an event line; ValueError where it is none."""
    value = loads(line.decode("utf-8"))
    if not isinstance(value, dict):
        raise ValueError("the line is no object")
    payload, snapshot = _field(value, "payload", dict) or {}, _field(value, "snapshot", dict) or {}
    for name in ("id", "type"):
        _field(value, name, str)
    _field(payload, "id", str)
    own, audit = _field(value, "timestamp", str), _field(value, "_audit_timestamp", str)
    taken, inner = _field(snapshot, "timestamp", str), _field(payload, "timestamp", str)
    ts = own if own is not None else taken
    if ts is None:
        ts = audit if source == "claude_local_agent" else inner if source == "codex_cli" else None
    cwd = _field(value, "cwd", str)
    return ts, cwd if cwd is not None else _field(payload, "cwd", str) if source == "codex_cli" else None


def lines_of(source: str, path: str, data: bytes, base: int, seq: int, start: int, end: int) -> Iterator[tuple]:
    """The committed lines between two offsets of a file, of which data are the bytes from base on, with seq lines before it; a bad line comes
    last, with its error."""
    seq, at = seq + data.count(b"\n", 0, start - base), start - base
    while at < end - base:
        stop = data.index(b"\n", at)
        line = data[at:stop]
        try:
            ts, cwd = event_header(source, line)
        except ValueError as error:
            yield path, seq, base + at, base + stop + 1, None, None, None, "invalid_json", str(error)
            return
        yield path, seq, base + at, base + stop + 1, ts, cwd, line, None, None
        seq, at = seq + 1, stop + 1


def raw_elements(text: str, name: str) -> list[str]:
    """The elements of a top-level array as they are written."""
    decoder = json.JSONDecoder()
    skip = lambda i: i + len(text[i:]) - len(text[i:].lstrip(" \t\r\n"))
    at = skip(skip(0) + 1)
    while text[at] != "}":
        key, at = scanstring(text, at + 1)
        at = skip(skip(at) + 1)
        if key == name:
            found, at = [], skip(at + 1)
            while text[at] != "]":
                _, stop = decoder.raw_decode(text, at)
                found.append(text[at:stop])
                at = skip(stop)
                at = skip(at + 1) if text[at] == "," else at
            return found
        _, at = decoder.raw_decode(text, at)
        at = skip(at)
        at = skip(at + 1) if text[at] == "," else at
    return []


def chat_of(path: str, data: bytes) -> Iterator[tuple]:
    """A chat's messages as events, each as it is written; the project's hash stands for a folder."""
    text = data.decode("utf-8")
    value = loads(text)
    project = value.get("projectHash")
    for seq, raw in enumerate(raw_elements(text, "messages")):
        message = loads(raw)
        ts = message.get("timestamp") if isinstance(message, dict) else None
        yield path, seq, 0, len(data), ts if isinstance(ts, str) else None, project if isinstance(project, str) else None, raw.encode(), None, None


def ranges(files: DataFrame) -> DataFrame:
    """The ranges of files (source, format, path, size, start, committed, marks) that are to be imported: (.., base, seq, low, high)."""
    places = F.from_json("marks", "array<array<bigint>>")
    spans = F.transform(places, lambda m, i: F.struct(m[0].alias("base"), m[1].alias("seq"), F.greatest(m[0], F.col("start")).alias("low"), F.coalesce(F.get(F.get(places, i + 1), F.lit(0)), F.col("committed")).alias("high")))
    rows = files.select("source", "format", "path", "size", F.explode(spans).alias("r")).select("source", "format", "path", "size", "r.*")
    return rows.where("format = 'json' or low < high")


def events(parts: DataFrame) -> DataFrame:
    """LINES of ranges: of each range up to a bad line. What follows a bad line in later ranges of its file isn't left out here."""

    def one(source, form, path, size, base, seq, low, high):
        try:
            data = read_bounded(path, size) if form == "json" else read_bounded(path, min(size, high), base)
        except OSError as error:
            yield path, 0, None, None, None, None, None, "read_error", str(error.strerror or error)
            return
        yield from chat_of(path, data) if form == "json" else lines_of(source, path, data, base, seq, low, min(high, base + len(data)))

    return parts.select("source", "format", "path", "size", "base", "seq", "low", "high").mapInArrow(_rows_of(one, LINES), LINES)


def up_to_the_first_bad(lines: DataFrame) -> DataFrame:
    """The lines of each file up to its first bad one, that included."""
    stops = lines.where("error_kind is not null").groupBy("path").agg(F.min("byte_offset").alias("stop"))
    return lines.join(stops, "path", "left").where("stop is null or byte_offset is null or byte_offset <= stop").drop("stop")


def blobs(spark, history_root: str) -> DataFrame:
    """(source_session_id, backup_name, blob) of the kept file states: <root>/<session>/<name>. An unreadable one fails the job."""
    from loomlog.sources.files import exists

    if not exists(spark, history_root):
        return spark.createDataFrame([], "source_session_id string, backup_name string, blob string")
    kept = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(history_root)
    parts = F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/")
    return kept.select(F.element_at(parts, -2).alias("source_session_id"), F.element_at(parts, -1).alias("backup_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("blob"))


def prefixes(files: DataFrame) -> DataFrame:
    """(file_path, prefix_fingerprint) of files (file_path, file_size, next_read_offset): the identity of what has been consumed of each."""

    def one(path, size, offset):
        digest = hashlib.sha256()
        try:
            for block in blocks(path, min(size, max(0, offset))):
                digest.update(block)
        except OSError:
            return path, None
        return path, digest.hexdigest()

    schema = "file_path string, prefix_fingerprint string"
    return files.select("file_path", "file_size", "next_read_offset").mapInArrow(_rows_of(one, schema, many=False), schema)
