"""Timestamps in mixed formats and zones as microseconds since 1970-01-01 UTC.

An offset, zone or abbreviation in the text decides, else the zone given with it, else UTC (also where the given zone is unknown).
Local times that occur twice mean the earlier instant; skipped ones move forward by the gap. Digits beyond microseconds are cut
off. Bare numbers count from 1970 in the unit that puts them into the years of DECADE. Null, empty and other texts, and dates or
times that don't exist (hour 24 and second 60 among them), have no instant.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from decimal import Decimal, localcontext
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions.strictjson import RawNumber, load_object

DECADE = (2020, 2030)
#: Zone abbreviations and their minutes east of UTC: fixed values.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "MYT": 480, "SGT": 480, "JST": 540, "AEST": 600, "AEDT": 660, "BRT": -180, "BRST": -120,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_ZONE = r"(?:\s*(?P<zone>[+-][0-9]{2}(?::?[0-9]{2})?|[A-Za-z][A-Za-z_]*(?:/[A-Za-z0-9_+-]+)*))?(?:\[(?P<name>[^\]]*)\])?"
_FRACTION = r"(?:[.,](?P<f>[0-9]+))?"
_NAMES = r"(?P<mon>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_SHAPES = [
    re.compile(r"(?P<y>[0-9]{4})([-/.])(?P<mo>[0-9]{1,2})\2(?P<d>[0-9]{1,2})(?:[Tt]|\s+)(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})" + _FRACTION + ")?" + _ZONE),
    re.compile(r"(?P<y>[0-9]{4})(?P<mo>[0-9]{2})(?P<d>[0-9]{2})[Tt](?P<h>[0-9]{2})(?P<mi>[0-9]{2})(?:(?P<s>[0-9]{2})" + _FRACTION + ")?" + _ZONE),
    re.compile(r"(?:[a-z]+,?\s+)?(?P<d>[0-9]{1,2})[\s-]+" + _NAMES + r"[\s-]+(?P<y>[0-9]{4})\s+(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})" + _FRACTION + r")?(?:\s*(?P<half>[ap]m))?" + _ZONE, re.I),
    re.compile(r"(?:[a-z]+,\s+)?" + _NAMES + r"\s+(?P<d>[0-9]{1,2}),?\s+(?P<y>[0-9]{4}),?\s+(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2})" + _FRACTION + r")?(?:\s*(?P<half>[ap]m))?" + _ZONE, re.I),
]
_BARE = re.compile(r"[+-]?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]{1,3})?")
_EPOCH = dt.datetime(1970, 1, 1)
_LOW, _HIGH = (int((dt.datetime(y, 1, 1) - _EPOCH).total_seconds()) for y in DECADE)


@lru_cache(1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # names of no zone raise several kinds
        return None


def _bare_number(text: str) -> int | None:
    with localcontext(prec=len(text) + 30):
        value = Decimal(text)
        for unit in (1, 10**3, 10**6, 10**9):
            if _LOW * unit <= value < _HIGH * unit:
                return int(value * 1_000_000 / unit)
    return None


def parse(text: str | None, zone: str | None = None) -> int | None:
    """Microseconds since 1970-01-01 UTC, or None."""
    if text is None:
        return None
    text = text.strip()
    if _BARE.fullmatch(text):
        return _bare_number(text)
    found = next((m for s in _SHAPES if (m := s.fullmatch(text))), None)
    if not found:
        return None
    g = found.groupdict()
    hour = int(g["h"])
    if g.get("half"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["half"].lower() == "pm")
    month = int(g["mo"]) if g.get("mo") else _MONTHS[g["mon"].lower()]
    try:
        local = dt.datetime(int(g["y"]), month, int(g["d"]), hour, int(g["mi"]), int(g["s"] or 0))
    except ValueError:
        return None
    micros = ((local - _EPOCH) // dt.timedelta(seconds=1)) * 1_000_000 + int(((g["f"] or "") + "000000")[:6])
    written, minutes = g["zone"], None
    if written:
        if written[0] in "+-":
            digits = written[1:].replace(":", "")
            hours, rest = int(digits[:2]), int(digits[2:] or 0)
            if hours > 23 or rest > 59:
                return None
            minutes = (hours * 60 + rest) * (-1 if written[0] == "-" else 1)
        elif written.upper() in ABBREVIATIONS:
            minutes = ABBREVIATIONS[written.upper()]
        elif _zone(written) is None:
            return None
    if minutes is None:
        place = _zone(written or g["name"] or zone or "UTC")
        if place is None:
            if g["name"] and not written:
                return None
            place = _zone("UTC")
        try:
            return micros - place.utcoffset(local) // dt.timedelta(microseconds=1)
        except OverflowError:
            return None
    return micros - minutes * 60_000_000


def parsed(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(raw, zone, instant_us) of the distinct (raw, zone) of values that known doesn't hold, each parsed once; null where there is no
    instant."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, zone = batch.column(0), batch.column(1)
            found = [parse(r, z) for r, z in zip(raw.to_pylist(), zone.to_pylist())]
            yield pa.RecordBatch.from_arrays([raw, zone, pa.array(found, pa.int64())], names=["raw", "zone", "instant_us"])

    new = values.where("raw is not null").select("raw", F.coalesce("zone", F.lit("UTC")).alias("zone")).distinct()
    if known is not None:
        new = new.join(known, ["raw", "zone"], "left_anti")
    return new.mapInArrow(run, "raw string, zone string, instant_us long")


def dictionary(values: DataFrame, keep, known: DataFrame | None = None) -> DataFrame:
    """(raw, zone, instant_us) of all distinct (raw, zone) of values and of known, the dictionary of earlier runs. keep(df, name) persists the
    new part."""
    new = keep(parsed(values, known), "instants")
    return new if known is None else known.unionByName(new)


def line_values(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(row_id, raw, zone) of payload.started_at, text or number, in lines that are single JSON objects. Only lines that can hold
    the name (as such, or in escapes) are parsed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for line_id, file_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                value = load_object(text, raw_numbers=True)
                payload = value.get("payload") if value else None
                at = payload.get("started_at") if isinstance(payload, dict) else None
                if isinstance(at, (str, RawNumber)):
                    for column, x in zip(out, (line_id, file_id, str(at).encode("utf-8", "replace").decode())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["row_id", "file_id", "raw"])

    can = F.col("raw_line").contains("started_at") | F.col("raw_line").contains("\\u")
    found = lines.where(can).select("line_id", "file_id", "raw_line").mapInArrow(run, "row_id long, file_id long, raw string")
    return found.join(files.select("file_id", F.col("tz_name").alias("zone")), "file_id", "left").select("row_id", "raw", "zone")


def normalised(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """rows (origin, row_id, raw, zone) with their instants from the dictionary; rows without an instant are left out."""
    keyed = rows.where("raw is not null").withColumn("zone", F.coalesce("zone", F.lit("UTC")))
    return keyed.join(parsed.where("instant_us is not null"), ["raw", "zone"]).select("origin", "row_id", "instant_us")
