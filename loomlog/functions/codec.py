"""The payload codec: raw or zstd, with the size of the decoded bytes beside it; and fingerprints of bytes.

Null payloads stay null; a payload that can't be decoded is null where `strict` is off and an error otherwise.
"""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads of fewer bytes stay raw; the codecs: fixed values.
MIN_BYTES = 1024
SUPPORTED = ("raw", "zstd")


_ENCODED = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("codec", T.StringType()), T.StructField("payload_size", T.LongType())])
_PLANNED = T.StructType([T.StructField("action", T.StringType()), T.StructField("saved", T.LongType()), T.StructField("packed", T.BinaryType())])


def compress(data: bytes | None) -> bytes | None:
    """The zstd form where it is at least MIN_BYTES long and gets smaller."""
    if data is None or len(data) < MIN_BYTES:
        return None
    packed = zstandard.ZstdCompressor().compress(data)
    return packed if len(packed) < len(data) else None


def decompress(data: bytes | None, codec: str | None, limit: int | None = None) -> bytes | None:
    """The decoded bytes, the first `limit` of them where one is given: only so much is decoded."""
    if data is None:
        return None
    if codec == "raw":
        return data if limit is None else data[:limit]
    if codec != "zstd":
        raise ValueError(f"unsupported codec {codec}")
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    return reader.read() if limit is None else reader.read(limit)


@F.pandas_udf(_ENCODED)
def encode(payloads: pd.Series) -> pd.DataFrame:
    packed = [compress(p) for p in payloads]
    return pd.DataFrame(
        {
            "payload": [p if z is None else z for p, z in zip(payloads, packed)],
            "codec": ["raw" if z is None else "zstd" for z in packed],
            "payload_size": [None if p is None else len(p) for p in payloads],
        }
    )


@F.pandas_udf(T.BinaryType())
def decode(payloads: pd.Series, codecs: pd.Series) -> pd.Series:
    return pd.Series([decompress(p, c) for p, c in zip(payloads, codecs)], dtype=object)


def decode_head(limit: int):
    """The first bytes of the decoded payload; null where it can't be decoded."""

    @F.pandas_udf(T.BinaryType())
    def head(payloads: pd.Series, codecs: pd.Series) -> pd.Series:
        def one(p, c):
            try:
                return decompress(p, c, limit)
            except (ValueError, zstandard.ZstdError):
                return None

        return pd.Series([one(p, c) for p, c in zip(payloads, codecs)], dtype=object)

    return head


@F.pandas_udf(_PLANNED)
def plan(payloads: pd.Series) -> pd.DataFrame:
    """What compaction does with a raw payload: small, not_smaller, round_trip_failed or compact, and the bytes it saves."""
    rows = []
    for p in payloads:
        if p is None or len(p) < MIN_BYTES:
            rows.append(("small", 0, None))
            continue
        packed = zstandard.ZstdCompressor().compress(p)
        if len(packed) >= len(p):
            rows.append(("not_smaller", 0, None))
        elif decompress(packed, "zstd") != p:
            rows.append(("round_trip_failed", 0, None))
        else:
            rows.append(("compact", len(p) - len(packed), packed))
    return pd.DataFrame(rows, columns=["action", "saved", "packed"])


def fingerprint(content: Column) -> Column:
    """The identity of bytes: used inside the journal only, never shown."""
    return F.sha2(content, 256)
