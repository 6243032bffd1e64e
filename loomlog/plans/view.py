"""What a reader of the journal sees: one view of sessions, the chosen session's events and errors; dumps and timelines of one session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions import codec, text
from loomlog.operators import journal
from loomlog.plans.store import Store


def view_of(store: Store, search: str | None = None, session_id: int | None = None, offset: int = 0, event_offset: int = 0, expanded: tuple[int, int] | None = None) -> dict:
    """sessions (a page) and has_next, the selected session's row, its events (a page without payloads) and has_more, the preview of the
    expanded event (generation, seq), and the newest unresolved errors.

    A search of at least three characters looks into the heads of the payloads, too."""
    sessions, events = store.table("sessions"), store.table("events")
    hits = None
    if search and len(search) >= journal.MIN_SEARCH:
        heads = events.select("session_id", codec.decode_head(4096)("payload", "codec").alias("head"))
        hits = journal.payload_hits(heads, search)
    found = journal.sessions_page(sessions, search, hits, offset=offset)
    rows = found.count()
    chosen = journal.selected(found, sessions, session_id)
    view = {"sessions": found.limit(journal.SESSION_PAGE), "has_next": rows > journal.SESSION_PAGE, "selected": chosen, "events": None, "has_more": False, "preview": None}
    if chosen is not None:
        own = events.where(F.col("session_id") == chosen["session_id"])
        page = journal.events_page(own, offset=event_offset)
        view |= {"events": page.limit(journal.EVENT_PAGE), "has_more": page.count() > journal.EVENT_PAGE}
        if expanded:
            one = own.where((F.col("generation") == expanded[0]) & (F.col("seq") == expanded[1])).select(codec.decode_head(4096)("payload", "codec").alias("head"))
            got = one.select(text.preview(F.col("head")).alias("shown")).first()
            view["preview"] = got["shown"] if got else None
    errors = journal.unresolved(store.table("ingest_errors")).withColumn("id", F.xxhash64("file_path", "error_kind"))
    return view | {"errors": journal.recent_errors(errors)}


def dump_events(store: Store, source: str, session: str, path: str, limit: int | None = None) -> None:
    """The decoded payloads of a session in order, one a line, into a new folder. LookupError where the session isn't known."""
    if not store.table("sessions").where((F.col("source") == source) & (F.col("source_session_id") == session)).limit(1).count():
        raise LookupError(f"no session {session} of {source}")
    rows = journal.guarded(journal.session_events(store.table("events"), store.table("sessions"), source, session, limit))
    rows.select(codec.decode("payload", "codec").cast("string").alias("value")).write.mode("errorifexists").text(path)


def show_timeline(store: Store, source: str, session: str, path: str) -> DataFrame:
    """The states of one file of a session, by seq; the path may be given as it was written. LookupError where there are none."""
    cwd = store.table("sessions").where((F.col("source") == source) & (F.col("source_session_id") == session)).select("source", "source_session_id", "cwd")
    rows = store.table("file_timelines").join(cwd, ["source", "source_session_id"]).where(F.col("file_path") == text.normalize_path(F.lit(path), F.col("cwd"))).drop("cwd")
    if not rows.limit(1).count():
        raise LookupError(f"no states of {path}")
    return rows.orderBy("seq")
