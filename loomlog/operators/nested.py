"""Deeply nested lines as flat child tables: Merkle identities of all objects, bridge rows for every occurrence.

Every object at any depth, and every element of the five child tables, is a node. A node is written canonically (names sorted by code
point, no white space, numbers as they stand, repeated names kept) with each node inside it replaced by a reference to that node's
identity, and hashed from the bottom up. In a body every object below the top is such a reference, so nothing that data hold looks like
one. Bodies are kept once under their identity; the bridge keeps each occurrence with its line, its parent's occurrence and ordinals, so
the lines can be put together again exactly, but for white space and the order of names. Null elements have no row but keep their position;
a label that is missing or no text is ''. Lines that are no single JSON object, null and empty lines have no rows; repeated lines have
rows of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.strictjson import RawNumber, Repeated, load_object

CHILD_TABLES = ["content_block", "result_block", "tracked_file", "tool_call", "todo"]
_COMPACT = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False)


def canonical(value) -> str:
    try:
        return _COMPACT.encode(value)
    except RecursionError:
        return "".join(_pieces(value))


def _pieces(value) -> Iterator[str]:
    """The same text without recursion, for values too deep for the encoder."""
    todo: list = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            yield x[0]
        elif isinstance(x, dict):
            parts: list = [("{",)]
            for i, k in enumerate(sorted(x)):
                parts += [(("," if i else "") + _COMPACT.encode(k) + ":",), x[k]]
            todo.extend(reversed([*parts, ("}",)]))
        elif isinstance(x, list):
            parts = [("[",)]
            for i, y in enumerate(x):
                parts += [*([(",",)] if i else []), y]
            todo.extend(reversed([*parts, ("]",)]))
        else:
            yield str(x) if isinstance(x, RawNumber) else _COMPACT.encode(x)


def identity(body: str) -> str:
    return hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _elements(value) -> list:
    """An array's elements; a non-empty text or an object alone is one element."""
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict) or isinstance(value, str) and value and not isinstance(value, RawNumber) else []


def _text(value) -> str:
    return value if isinstance(value, str) and not isinstance(value, RawNumber) else ""


def _block_label(block) -> str:
    return _text(block.get("type")) if isinstance(block, dict) else "text" if isinstance(block, str) else ""


#: How a body refers to another node.
REFERENCE = "$node"


def _named(line: dict) -> dict[tuple[int, object], tuple[str, int, int, str]]:
    """(child_table, parent_pos, pos, label) of the elements of the child tables, by the container they stand in and their place there."""
    found: dict[tuple[int, object], tuple[str, int, int, str]] = {}

    def blocks(holder: dict, table: str, parent_pos: int) -> Iterator[tuple[int, object]]:
        content = holder.get("content")
        if isinstance(content, list):
            for pos, block in enumerate(content):
                found[id(content), pos] = (table, parent_pos, pos, _block_label(block))
                yield pos, block
        elif isinstance(content, dict) or isinstance(content, str) and content and not isinstance(content, RawNumber):
            found[id(holder), "content"] = (table, parent_pos, 0, _block_label(content))
            yield 0, content

    def elements(values: list, table: str, parent_pos: int, name: str) -> None:
        for pos, e in enumerate(values):
            found[id(values), pos] = (table, parent_pos, pos, _text(e.get(name)) if isinstance(e, dict) else "")

    message = line.get("message")
    for pos, block in blocks(message, "content_block", 0) if isinstance(message, dict) else ():
        if isinstance(block, dict) and block.get("type") == "tool_result":
            list(blocks(block, "result_block", pos))
    snapshot = line.get("snapshot")
    backups = snapshot.get("trackedFileBackups") if isinstance(snapshot, dict) else None
    if isinstance(backups, list):
        elements(backups, "tracked_file", 0, "filePath")
    elif isinstance(backups, dict):
        for pos, key in enumerate(sorted(backups, key=lambda k: k.encode("utf-8", "surrogatepass"))):
            found[id(backups), key] = ("tracked_file", 0, pos, key)
    messages = line.get("messages")
    for nth, m in enumerate(messages) if isinstance(messages, list) else ():
        if isinstance(m, dict) and isinstance(m.get("toolCalls"), list):
            elements(m["toolCalls"], "tool_call", nth, "name")
    todos = line.get("todos")
    if isinstance(todos, dict) and isinstance(todos.get("todos"), list):
        elements(todos["todos"], "todo", 0, "content")
    return found


def _slots(container) -> list[tuple[object, object]]:
    return container.pairs if isinstance(container, Repeated) else list(container.items() if isinstance(container, dict) else enumerate(container))


def nodes(line: dict) -> list[list]:
    """[child_table, parent_pos, pos, label, node, parent, at, parent_at, body] of all nodes of a line, itself the first with child_table ''.

    at numbers the occurrences in a line, parent_at is that of the node around one. Objects that are in no child table have child_table
    'object', their place below that node as label and their place in an array as pos. Without recursion: from the top down all containers
    are listed, from the last to the first they are written."""
    named = _named(line)
    rows: list[list] = [["", 0, 0, "", None, None, 0, None, None]]
    todo: list[tuple] = [(line, 0, 0, "")]  # container, the node it belongs to, its own node or None, its place below that
    inside: list[list] = []  # of each container: (name or None, number of the inner container or None, node or None, value)
    for container, owner, _, place in todo:
        held = isinstance(container, dict)
        parts = []
        slots = _slots(container)
        last = {key: i for i, (key, _) in enumerate(slots)} if isinstance(container, Repeated) else None
        for i, (key, value) in enumerate(slots):
            own = named.get((id(container), key)) if last is None or last[key] == i else None
            is_node = value is not None and (own is not None or isinstance(value, dict))
            number = None
            if is_node:
                number = len(rows)
                below = f"{place}/{key.replace('~', '~0').replace('/', '~1') if held else key}"
                rows.append([*(own or ("object", 0, 0 if held else key, below)), None, None, number, owner, None])
            inner = None
            if isinstance(value, (dict, list)):
                inner = len(todo)
                todo.append((value, owner if number is None else number, number, "" if is_node else f"{place}/{key.replace('~', '~0').replace('/', '~1') if held else key}"))
            parts.append((key if held else None, inner, number, value))
        inside.append(parts)
    texts: list[str] = [""] * len(todo)
    encode = _COMPACT.encode
    for k in range(len(todo) - 1, -1, -1):
        parts = inside[k]
        held = isinstance(todo[k][0], dict)
        if held:
            parts.sort(key=lambda p: p[0])
        out = []
        for name, inner, number, value in parts:
            text = texts[inner] if inner is not None else str(value) if isinstance(value, RawNumber) else encode(value)
            if number is not None:
                row = rows[number]
                row[8], row[4] = text, identity(text)
                text = f'{{"{REFERENCE}":"{row[4]}"}}'
            out.append(text if name is None else f"{encode(name)}:{text}")
        texts[k] = f"{{{','.join(out)}}}" if held else f"[{','.join(out)}]"
    rows[0][8], rows[0][4] = texts[0], identity(texts[0])
    for row in rows[1:]:
        row[5] = rows[row[7]][4]
    return rows


_COLUMNS = ["line_id", "child_table", "parent_pos", "pos", "label", "node", "parent", "at", "parent_at"]


def _valid(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode()  # lone surrogates have no UTF-8


def bridge(lines: DataFrame) -> DataFrame:
    """(line_id, child_table, parent_pos, pos, label, node, parent, at, parent_at): one row per occurrence of a node, lines among them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for line_id, raw in zip(*(c.to_pylist() for c in batch.columns)):
                value = load_object(raw, all_names=True)
                if value is not None:
                    out += [(line_id, *row[:3], _valid(row[3]), *row[4:8]) for row in nodes(value)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 9, types)], names=_COLUMNS)

    texts = {"child_table", "label", "node", "parent"}
    types = [pa.string() if n in texts else pa.int64() for n in _COLUMNS]
    schema = ", ".join(f"{n} {'string' if n in texts else 'long'}" for n in _COLUMNS)
    return lines.select("line_id", "raw_line").mapInArrow(run, schema)


def occurrences(lines: DataFrame) -> DataFrame:
    """(line_id, child_table, parent_pos, pos, label) of all elements of the child tables, as far as they are nodes."""
    return bridge(lines).where(F.col("child_table").isin(CHILD_TABLES)).select("line_id", "child_table", "parent_pos", "pos", "label")


def objects(lines: DataFrame) -> DataFrame:
    """(node, body, occurrences): each distinct node once. What repeats within a batch is put together before anything is shuffled. Characters
    that have no UTF-8 stay escaped in the body."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies: dict[str, list] = {}
            for raw in batch.column(0).to_pylist():
                value = load_object(raw, all_names=True)
                for row in nodes(value) if value is not None else ():
                    kept = bodies.setdefault(row[4], [row[8], 0])
                    kept[1] += 1
            texts = [_escaped(body) for body, _ in bodies.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(bodies), pa.string()), pa.array(texts, pa.string()), pa.array([n for _, n in bodies.values()], pa.int64())], names=["node", "body", "n"])

    rows = lines.select("raw_line").mapInArrow(run, "node string, body string, n long")
    return rows.groupBy("node").agg(F.first("body").alias("body"), F.sum("n").alias("occurrences"))


def _escaped(text: str) -> str:
    return text if text.isascii() else "".join(f"\\u{ord(c):04x}" if "\ud800" <= c <= "\udfff" else c for c in text)


def whole(node: str, body_of) -> object:
    """The value of a node, put together again; body_of gives a node's body. Numbers are RawNumber, repeated names Repeated."""
    from loomlog.functions.strictjson import loads

    def parsed(name: str):
        return loads(body_of(name), all_names=True)

    root = [parsed(node)]
    todo: list[tuple] = [(root, 0, True)]
    while todo:
        holder, key, top = todo.pop()
        value = holder[key]
        if isinstance(value, dict) and not top:
            holder[key] = value = parsed(value[REFERENCE])
        if isinstance(value, Repeated):
            pairs = [list(p) for p in value.pairs]
            value.pairs = pairs
            todo.extend((p, 1, False) for p in pairs)
        elif isinstance(value, dict):
            todo.extend((value, k, False) for k in value)
        elif isinstance(value, list):
            todo.extend((value, k, False) for k in range(len(value)))
    return root[0]
