"""The journal from the command line: python -m loomlog --journal FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys


def arguments(given: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="loomlog")
    parser.add_argument("--journal", required=True, help="the folder of the journal")
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, **k: commands.add_parser(name, **k)
    add("ingest", help="one pass over the session files of a home").add_argument("--home", default=os.path.expanduser("~"))
    add("status", help="counts of sessions, events and errors, and of codecs")
    add("doctor", help="unresolved errors").add_argument("--details", type=int, default=0)
    sessions = add("sessions", help="a page of sessions")
    sessions.add_argument("--search")
    sessions.add_argument("--offset", type=int, default=0)
    events = add("events", help="the payloads of a session into a new folder")
    for name in ("source", "session", "output"):
        events.add_argument(name)
    events.add_argument("--limit", type=int)
    add("compact", help="what compaction does with raw payloads").add_argument("--apply", action="store_true")
    add("vacuum", help="deletes what no version names")
    add("pack", help="an archive of the journal").add_argument("--output")
    settle = add("settle", help="the journal of an archive")
    settle.add_argument("archive")
    settle.add_argument("--force", action="store_true")
    extract = add("extract", help="labelled examples")
    extract.add_argument("--history", required=True)
    extract.add_argument("--force", action="store_true")
    extract.add_argument("--session", nargs=2, metavar=("SOURCE", "SESSION"))
    add("labels", help="the labelled examples by outcome and evidence")
    timeline = add("timeline", help="the states of a file")
    for name in ("source", "session", "path"):
        timeline.add_argument(name)
    add("export", help="(context, chosen, rejected) as JSON lines into a new folder").add_argument("output")
    return parser.parse_args(given)


def run(spark, args: argparse.Namespace):
    """The result of a command: a dictionary, or rows."""
    from loomlog.operators import journal, taste
    from loomlog.plans import ingest, transfer, view
    from loomlog.plans.store import Store

    store = Store(spark, args.journal)
    match args.command:
        case "ingest":
            return ingest.run(spark, args.home, store)
        case "status":
            counts = journal.status(store.table("sessions"), store.table("events"), journal.unresolved(store.table("ingest_errors"))).first().asDict()
            return counts | journal.codec_stats(store.table("events")).first().asDict()
        case "doctor":
            errors = journal.unresolved(store.table("ingest_errors"))
            return errors.orderBy("last_seen_at", ascending=False).limit(args.details).collect() if args.details else journal.doctor(errors)[0].first().asDict()
        case "sessions":
            return view.view_of(store, search=args.search, offset=args.offset)["sessions"].collect()
        case "events":
            view.dump_events(store, args.source, args.session, args.output, args.limit)
            return {"written": args.output}
        case "compact":
            return ingest.compact(store, args.apply)
        case "vacuum":
            reclaimed = store.reclaimable()
            return {"folders": store.vacuum(), "bytes": reclaimed}
        case "pack":
            target = args.output or transfer.default_name()
            return {"archive": target} | transfer.pack(store, target)
        case "settle":
            return transfer.settle(spark, args.archive, args.journal, args.force)
        case "extract":
            return ingest.extract(spark, store, args.history, args.force, session=tuple(args.session) if args.session else None)
        case "labels":
            return taste.status(store.table("preference_examples")).first().asDict()
        case "timeline":
            return view.show_timeline(store, args.source, args.session, args.path).collect()
        case "export":
            taste.export(store.table("preference_examples"), args.output)
            return {"written": args.output}


def main(given: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if given is None else given)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("loomlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        found = run(spark, args)
    except (LookupError, ValueError, FileExistsError, RuntimeError) as error:
        print(f"loomlog: {error}", file=sys.stderr)
        return 1
    for row in found if isinstance(found, list) else [found]:
        print(json.dumps(row if isinstance(row, dict) else row.asDict(), default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
