"""The journal's tables in shared storage: versions of state tables, appended events, and one pointer that makes a run visible.

Layout: <root>/data/<table>-<run>/ (Parquet) and <root>/journal.json, which names the schema version and the folders that hold now. A run
writes new folders and then replaces the pointer in one rename, so that a failed or repeated run changes nothing that is seen.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
SCHEMAS = {
    "sessions": "session_id long, source string, source_session_id string, file_path string, cwd string, parent_source_session_id string, parent_session_id long, started_at string, ended_at string,"
    " current_generation long, file_mtime long, file_size long, content_fingerprint string, prefix_fingerprint string, next_read_offset long, event_count long, source_metadata string, created_at string, updated_at string",
    "events": "session_id long, generation long, seq long, ts string, payload binary, codec string, payload_size long, created_at string",
    "ingest_errors": "source string, source_session_id string, file_path string, generation long, byte_offset long, line_number long, error_kind string, message string, first_seen_at string, last_seen_at string,"
    " occurrence_count long, resolved_at string, resolution_note string",
    "file_timelines": "source string, source_session_id string, file_path string, seq long, event_seq long, content string, trigger_event_ref string, source_kind string",
    "preference_examples": "source string, source_session_id string, generation long, proposal_event_seq long, tool_use_id string, file_path string, tool_name string, proposal_content string, context string, outcome string,"
    " confidence double, evidence_kind string, extractor_version string",
    "taste_extractions": "source string, source_session_id string, extractor_version string, event_count long, extracted_at string",
    "instants": "raw string, zone string, instant_us long",
}
APPENDED = {"events", "instants"}
#: Tables that are replaced by session: in so many parts by the hash of the session, of which a run writes those it touches.
BY_SESSION = {"file_timelines", "preference_examples", "taste_extractions"}
PARTS = 256
POINTER, LOCK = "journal.json", "journal.lock"
#: A writer touches its lock every BEAT seconds; one that hasn't been touched for STALE seconds has no owner any more.
BEAT, STALE = 30.0, 600.0


class Store:
    """A journal at a root folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str, replace: bool) -> None:
        stream = self._fs.create(self._path(f"{self.root}/{name}"), replace)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def state(self) -> dict:
        text = self._read(POINTER)
        state = json.loads(text) if text else {"schema_version": SCHEMA_VERSION, "tables": {}}
        if state["schema_version"] > SCHEMA_VERSION:
            raise RuntimeError(f"the journal has schema version {state['schema_version']}; this code reads up to {SCHEMA_VERSION}")
        return state

    def table(self, name: str) -> DataFrame:
        folders = self.state()["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64("source", "source_session_id"), F.lit(PARTS)).cast("int")

    def replace_sessions(self, touched: DataFrame, **tables: DataFrame) -> None:
        """The rows of the touched sessions (source, source_session_id) anew, in all given tables at once: what they had is gone, also where
        there are no new rows. Only the parts that hold touched sessions are read and written."""
        run, state = uuid.uuid4().hex[:12], self.state()
        parts = sorted(r["part"] for r in touched.select(self.part_of().alias("part")).distinct().collect())  # PARTS at most
        for name, df in tables.items():
            held = state["tables"].get(name, [])
            mine = [f for f in held if int(f.rpartition("=")[2]) in set(parts)]
            old = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/data/{f}" for f in mine]) if mine else self.spark.createDataFrame([], SCHEMAS[name])
            kept = old.join(touched.select("source", "source_session_id").distinct(), ["source", "source_session_id"], "left_anti")
            folder = f"{name}-{run}"
            rows = kept.unionByName(df.select(kept.columns)).withColumn("part", self.part_of())
            rows.repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
            written = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/data/{folder}")) if s.isDirectory()]
            state["tables"][name] = sorted(set(held) - set(mine)) + [f"{folder}/{part}" for part in sorted(written)]
        self._show(state, run)

    def _owned(self) -> str | None:
        """Who holds the lock, or None where its owner is gone: a process of this machine that doesn't run, or one that has stopped touching
        it."""
        try:
            owner = json.loads(self._read(LOCK) or "{}")
            touched = self._fs.getFileStatus(self._path(f"{self.root}/{LOCK}")).getModificationTime() / 1000
        except Exception:  # another run has just let it go, or is writing it
            return "another run"
        if owner.get("host") == socket.gethostname() and owner.get("pid"):
            try:
                os.kill(owner["pid"], 0)
            except ProcessLookupError:
                return None
            except PermissionError:
                pass
        return None if time.time() - touched > STALE else f"{owner.get('host', 'another machine')}, process {owner.get('pid')}, since {owner.get('since')}"

    def _lock(self, mark: str) -> None:
        path = self._path(f"{self.root}/{LOCK}")
        for _ in range(2):
            try:
                self._write(LOCK, mark, False)
                return
            except Exception as error:
                if not self._fs.exists(path):
                    raise
                owner = self._owned()
                if owner is not None:
                    raise RuntimeError(f"another run writes this journal: {owner}") from error
                left = self._path(f"{self.root}/{LOCK}.left-{uuid.uuid4().hex}")
                if self._fs.rename(path, left):  # one run alone succeeds in this
                    self._fs.delete(left, False)
        raise RuntimeError("another run writes this journal")

    @contextmanager
    def writing(self):
        """The only writer: a lock file that can't be created twice, with its owner; it is taken from an owner that is gone."""
        mark = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "since": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "run": uuid.uuid4().hex})
        self._lock(mark)
        path, done = self._path(f"{self.root}/{LOCK}"), threading.Event()

        def beat() -> None:
            while not done.wait(BEAT):
                self._fs.setTimes(path, int(time.time() * 1000), -1)

        thread = threading.Thread(target=beat, daemon=True)
        thread.start()
        try:
            yield self
        finally:
            done.set()
            thread.join()
            if self._read(LOCK) == mark:
                self._fs.delete(path, False)

    def commit(self, **tables: DataFrame) -> dict[str, int]:
        """Writes new versions (events: what is added) and then shows all of them at once. Returns the rows written."""
        run, state, rows = uuid.uuid4().hex[:12], self.state(), {}
        if wrong := BY_SESSION & set(tables):
            raise ValueError(f"{wrong} are replaced by session")
        for name, df in tables.items():
            folder = f"{name}-{run}"
            shaped = df.select(*[F.col(c.strip().split()[0]).cast(c.strip().split()[1]) for c in SCHEMAS[name].split(",")])
            shaped.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
            rows[name] = self.spark.read.parquet(f"{self.root}/data/{folder}").count()
            if name not in APPENDED:
                state["tables"][name] = [folder]
            elif rows[name]:
                state["tables"][name] = [*state["tables"].get(name, []), folder]
        self._show(state, run)
        return rows

    def _show(self, state: dict, run: str) -> None:
        self._write(f"{POINTER}.{run}", json.dumps(state), True)
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(f"{self.root}/{POINTER}.{run}"), self._path(f"{self.root}/{POINTER}"), options)

    def replace(self, name: str, df: DataFrame) -> None:
        """A new version of a table, appended ones included."""
        run, state = uuid.uuid4().hex[:12], self.state()
        df.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}-{run}")
        state["tables"][name] = [f"{name}-{run}"]
        self._show(state, run)

    def replace_folders(self, name: str, folders: list[str], df: DataFrame) -> None:
        """The rows of some folders of an appended table anew, in one folder; the others stay as they are."""
        run, state = uuid.uuid4().hex[:12], self.state()
        df.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}-{run}")
        state["tables"][name] = [f for f in state["tables"][name] if f not in folders] + [f"{name}-{run}"]
        self._show(state, run)

    def unseen(self) -> list[str]:
        """Folders that no pointer names: what runs that failed, or versions since replaced, have left."""
        data = self._path(f"{self.root}/data")
        if not self._fs.exists(data):
            return []
        named = {f.partition("/")[0] for folders in self.state()["tables"].values() for f in folders}
        return sorted({s.getPath().getName() for s in self._fs.listStatus(data)} - named)

    def reclaimable(self) -> int:
        """The bytes that vacuum() would free."""
        return sum(self._fs.getContentSummary(self._path(f"{self.root}/data/{f}")).getLength() for f in self.unseen())

    def vacuum(self) -> list[str]:
        gone = self.unseen()
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
        return gone

    def pack(self, target: str) -> None:
        """A copy of what is seen, into a new folder only."""
        other = Store(self.spark, target)
        if other._fs.exists(self._path(target)):
            raise FileExistsError(target)
        other._take(self)

    def check(self) -> list[str]:
        """What a restored journal lacks: columns, or unique keys."""
        keys = {"sessions": ["source", "source_session_id"], "events": ["session_id", "generation", "seq"], "preference_examples": ["source", "source_session_id", "generation"], "instants": ["raw", "zone"]}
        wrong = []
        for name, folders in self.state()["tables"].items():
            if name not in SCHEMAS:
                wrong.append(f"{name}: unknown table")
                continue
            want = self.spark.createDataFrame([], SCHEMAS[name]).dtypes
            if not folders:
                continue
            have = dict(self.spark.read.parquet(*[f"{self.root}/data/{f}" for f in folders]).dtypes)
            wrong += [f"{name}: {c} isn't {t}" for c, t in want if have.get(c) != t]
            if name in keys and self.table(name).groupBy(*keys[name]).count().where("count > 1").limit(1).count():
                wrong.append(f"{name}: keys aren't unique")
        return wrong

    def restore(self, source: str) -> None:
        """The tables of a packed journal, validated, in place of those seen now."""
        other = Store(self.spark, source)
        if wrong := other.check():
            raise ValueError("; ".join(wrong))
        self._take(other)

    def _take(self, other: Store) -> None:
        """All tables of another journal in place of one's own, folder by folder where they are kept by session."""
        state, run = {"schema_version": SCHEMA_VERSION, "tables": {}}, uuid.uuid4().hex[:12]
        for name, folders in other.state()["tables"].items():
            rows = other.table(name)
            if name in BY_SESSION:
                rows.withColumn("part", self.part_of()).repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(f"{self.root}/data/{name}-{run}")
                there = self._fs.listStatus(self._path(f"{self.root}/data/{name}-{run}"))
                state["tables"][name] = sorted(f"{name}-{run}/{s.getPath().getName()}" for s in there if s.isDirectory())
            else:
                rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}-{run}")
                state["tables"][name] = [f"{name}-{run}"]
        self._show(state, run)
