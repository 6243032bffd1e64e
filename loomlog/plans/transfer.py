"""A journal as one archive: packed from what is seen, checked entry by entry, staged, validated, and only then put in place.

For journals of a size that one machine can stream; larger ones are copied by Store.pack, folder by folder on the executors. The archive
lies on a mounted file system; the journal may lie on any that Arrow knows.
"""

from __future__ import annotations

import io
import json
import os
import shutil
import tarfile
import tempfile
import time
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

from loomlog.plans.store import POINTER, SCHEMAS, Store

#: The only kinds of entries at the top of an archive: fixed values.
TOP = (POINTER, "data")


def default_name(now: float | None = None) -> str:
    """A name that sorts by the time (UTC)."""
    return time.strftime("journal-pack-%Y%m%d-%H%M%SZ.tar.gz", time.gmtime(now))


def _files(store: Store, folder: str):
    """(name below data, path, size) of a folder's table files."""
    listed = store._fs.listFiles(store._path(f"{store.root}/data/{folder}"), True)
    while listed.hasNext():
        status = listed.next()
        path = status.getPath().toString()
        if path.endswith(".parquet"):
            yield path[path.rindex(f"/data/{folder}") + len("/data/") :], path.removeprefix("file:"), status.getLen()


def pack(store: Store, target: str) -> dict[str, int]:
    """Writes an archive that doesn't exist yet, readable by its owner only; returns the rows of sessions and events in it."""
    from loomlog.sources.contents import opened

    state = store.state()
    with os.fdopen(os.open(target, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as out, tarfile.open(fileobj=out, mode="w:gz") as archive:
        text = json.dumps(state).encode()
        head = tarfile.TarInfo(POINTER)
        head.size = len(text)
        archive.addfile(head, io.BytesIO(text))
        for folder in sorted(f for folders in state["tables"].values() for f in folders):
            for name, path, size in _files(store, folder):
                entry = tarfile.TarInfo(f"data/{name}")
                entry.size = size
                with opened(path) as file:
                    archive.addfile(entry, file)
    return {name: store.table(name).count() for name in ("sessions", "events")}


def wrong_entry(entry: tarfile.TarInfo) -> str | None:
    """Why an entry must not be taken out of an archive."""
    path = PurePosixPath(entry.name)
    if not (entry.isreg() or entry.isdir()):
        return f"{entry.name}: neither a file nor a folder"
    if path.is_absolute() or ".." in path.parts or not path.parts:
        return f"{entry.name}: leads out of the journal"
    if path.parts[0] not in TOP:
        return f"{entry.name}: no part of a journal"
    if path.parts[0] == "data" and len(path.parts) > 1 and path.parts[1].rpartition("-")[0] not in SCHEMAS:
        return f"{entry.name}: unknown table"
    return None


def settle(spark: SparkSession, source: str, root: str, force: bool = False) -> dict[str, int]:
    """The journal of an archive at root: refused over an existing one unless forced, and in place only once it is whole and valid."""
    store = Store(spark, root)
    if store.state()["tables"] and not force:
        raise FileExistsError(f"{root} holds a journal")
    staged = tempfile.mkdtemp(prefix="journal-staged-")
    shared = staged if "://" not in root else f"{root}/staged-{os.path.basename(staged)}"
    try:
        with tarfile.open(source, "r:gz") as archive:
            entries = archive.getmembers()
            if wrong := [w for e in entries if (w := wrong_entry(e))]:
                raise ValueError("; ".join(wrong))
            if POINTER not in {e.name for e in entries}:
                raise ValueError("the archive has no journal")
            archive.extractall(staged, entries, filter="data")
        if shared != staged:  # to where executors read
            store._fs.copyFromLocalFile(False, True, store._path(staged), store._path(shared))
        with store.writing():
            store.restore(shared)
    finally:
        if shared != staged:
            store._fs.delete(store._path(shared), True)
        shutil.rmtree(staged, ignore_errors=True)
    return {name: store.table(name).count() for name in ("sessions", "events")}
