"""Binary layout of one vector: little-endian length and id, length and floats, length
and metadata, timestamp and a deleted byte."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


class InvalidFormat(ValueError):
    pass


def pack(point_id: str, values: list[float], metadata: str | None, ts_ns: int, deleted: bool) -> bytes:
    name, meta = point_id.encode(), (metadata or "").encode()
    return b"".join((
        struct.pack("<I", len(name)), name, struct.pack(f"<I{len(values)}f", len(values), *values),
        struct.pack("<I", len(meta)), meta, struct.pack("<q?", ts_ns, deleted),
    ))


def unpack(raw: bytes) -> tuple[str, list[float], str | None, int, bool]:
    """Inverse of pack; InvalidFormat for anything else. Metadata is kept."""
    try:
        (n,) = struct.unpack_from("<I", raw, 0)
        at = 4 + n
        name = raw[4:at]
        (k,) = struct.unpack_from("<I", raw, at)
        if len(name) != n or at + 4 + 4 * k > len(raw):
            raise InvalidFormat("truncated vector")
        values = list(struct.unpack_from(f"<{k}f", raw, at + 4))
        at += 4 + 4 * k
        (m,) = struct.unpack_from("<I", raw, at)
        meta = raw[at + 4 : at + 4 + m]
        ts, deleted = struct.unpack_from("<q?", raw, at + 4 + m)
        if at + 4 + m + 9 != len(raw):
            raise InvalidFormat("trailing bytes")
        return name.decode(), values, meta.decode() or None, ts, deleted
    except (struct.error, UnicodeDecodeError) as e:
        raise InvalidFormat(str(e)) from None


def serialized(points: DataFrame) -> DataFrame:
    """(id, body) of points (id, values, metadata, ts_ns, deleted)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            body = [pack(i, list(v) if v is not None else [], m, int(t), bool(d)) for i, v, m, t, d in zip(p["id"], p["values"], p["metadata"], p["ts_ns"], p["deleted"], strict=True)]
            yield pd.DataFrame({"id": p["id"], "body": body})

    return points.select("id", "values", "metadata", "ts_ns", "deleted").mapInPandas(run, "id string, body binary")


def deserialized(bodies: DataFrame) -> DataFrame:
    """Points of rows (body); a body that is not one fails the query with InvalidFormat."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([unpack(bytes(b)) for b in p["body"]], columns=["id", "values", "metadata", "ts_ns", "deleted"])

    return bodies.select("body").mapInPandas(run, "id string, values array<float>, metadata string, ts_ns bigint, deleted boolean")
