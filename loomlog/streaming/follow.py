"""Following session files as a stream: committed lines as they are appended, each once, rewritten files as a new generation.

spark.readStream.format("session_file_lines").option("path", folder).load() gives (path, generation, byte_offset, line). The offset holds
for each file how far it was read, its generation, and the hash of all bytes before that place, by which a rewrite is seen. Ranges of files
are read on the executors; the hash is taken on the driver, which reads a file again unless the running stream knows its size, times and
inode from more than two seconds after its last change. An unterminated last line waits until it ends.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

MARK_BYTES = 4096
BYTES_PER_PARTITION = 32 << 20


class FileRange(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int):
        self.path, self.generation, self.start, self.end = path, generation, start, end


def _hashes(path: str, *ends: int) -> list[str]:
    """The hashes of a file's bytes up to each of rising places."""
    digest, done, out = hashlib.sha256(), 0, []
    with open(path, "rb") as file:
        for end in ends:
            while done < end and (block := file.read(min(1 << 20, end - done))):
                digest.update(block)
                done += len(block)
            out.append(digest.hexdigest())
    return out


def _mark(path: str, at: int) -> str:
    """What older checkpoints have instead of the hash: a shorter one, of the last bytes alone."""
    with open(path, "rb") as file:
        file.seek(max(0, at - MARK_BYTES))
        return hashlib.sha256(file.read(min(at, MARK_BYTES))).hexdigest()[:16]


def committed_end(path: str, size: int, least: int) -> int:
    """The place after the last line end below size, looked for backwards down to `least`."""
    with open(path, "rb") as file:
        at = size
        while at > least:
            begin = max(least, at - (1 << 16))
            file.seek(begin)
            found = file.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return least


def _planned(checkpoint: str) -> dict:
    """The last offset that a query has planned: a reader that starts again isn't told."""
    folder = os.path.join(checkpoint, "offsets")
    numbers = [int(n) for n in os.listdir(folder) if n.isdigit()] if os.path.isdir(folder) else []
    if not numbers:
        return {}
    with open(os.path.join(folder, str(max(numbers))), encoding="utf-8") as file:
        return json.loads(file.read().splitlines()[-1])


class LineStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str, checkpoint: str | None):
        self.root, self.suffix = root, suffix
        self.known: dict = _planned(checkpoint) if checkpoint else {}
        self.seen: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        found = dict(self.known)
        for folder, _, names in os.walk(self.root):
            for name in sorted(names):
                if not name.endswith(self.suffix):
                    continue
                path = os.path.join(folder, name)
                now, state = time.time_ns(), os.stat(path)
                seen = (state.st_size, state.st_mtime_ns, state.st_ctime_ns, state.st_ino)
                if path in found and self.seen.get(path) == seen:
                    continue
                size = state.st_size
                at, generation, mark = found.get(path, (0, 0, ""))
                end = committed_end(path, size, at)
                before, after = _hashes(path, at, end) if size >= at else ("", "")
                old = len(mark) == 16
                if size < at or at and (_mark(path, at) if old else before) != mark:
                    at, generation = 0, generation + 1
                    end = committed_end(path, size, at)
                    after = _hashes(path, end)[0]
                if end > at or path not in found or found[path][1] != generation or old:
                    found[path] = [end, generation, after]
                if max(seen[1:3]) < now - 2_000_000_000:
                    self.seen[path] = seen
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        parts = []
        for path, (stop, generation, _) in sorted(end.items()):
            at = start[path][0] if path in start and start[path][1] == generation else 0
            while at < stop:
                to = stop if stop - at <= BYTES_PER_PARTITION else committed_end(path, at + BYTES_PER_PARTITION, at)
                to = stop if to == at else to
                parts.append(FileRange(path, generation, at, to))
                at = to
        return parts

    def read(self, partition: FileRange) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            file.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = file.readline()
                yield partition.path, partition.generation, at, line[:-1]
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the offset itself."""


class SessionFileLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_file_lines"

    def schema(self) -> str:
        return "path string, generation long, byte_offset long, line binary"

    def streamReader(self, schema: StructType) -> LineStreamReader:
        return LineStreamReader(self.options["path"], self.options.get("suffix", ".jsonl"), self.options.get("checkpoint"))


def lines(spark: SparkSession, root: str, checkpoint: str, suffix: str = ".jsonl") -> DataFrame:
    """The stream; checkpoint is that of the query, on a mounted file system."""
    from loomlog.tables import ship

    ship(spark)
    spark.dataSource.register(SessionFileLines)
    return spark.readStream.format("session_file_lines").option("path", root).option("suffix", suffix).option("checkpoint", checkpoint).load()


def follow(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the committed lines below root to target until there are no more: each batch has its own folder, which a repeated batch
    replaces, so that every line comes once whatever fails."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return lines(spark, root, checkpoint).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
