"""Geometries in well-known binary: envelopes, and equality without regard to where a ring starts.

Points, by far the most of a journal, are decoded a batch at a time; other types by a small reader.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([T.StructField(k, T.DoubleType()) for k in ("xmin", "ymin", "xmax", "ymax")])
#: Relative tolerance of coordinates that count as equal, absolute near zero.
TOLERANCE = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class _Reader:
    """Coordinates of one geometry, part by part, as (type, ring points)."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.parts = data, 0, []

    def take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def points(self, order: str, n: int, width: int) -> list[tuple]:
        values = self.take(f"{order}{n * width}d")
        return [values[i : i + width] for i in range(0, len(values), width)]

    def geometry(self) -> None:
        order = "<" if self.take("B")[0] else ">"
        code = self.take(f"{order}I")[0]
        width = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            self.take(f"{order}I")
        code &= 0x1FFFFFFF
        width += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind = code % 1000
        if kind == 1:
            self.parts.append((1, self.points(order, 1, width)))
        elif kind == 2:
            self.parts.append((2, self.points(order, self.take(f"{order}I")[0], width)))
        elif kind == 3:
            for _ in range(self.take(f"{order}I")[0]):
                self.parts.append((3, self.points(order, self.take(f"{order}I")[0], width)))
        elif kind in (4, 5, 6, 7):
            for _ in range(self.take(f"{order}I")[0]):
                self.geometry()
        else:
            raise ValueError(kind)


def _parts(data: bytes | None) -> list | None:
    if not data:
        return None
    reader = _Reader(data)
    try:
        reader.geometry()
    except (ValueError, KeyError, struct.error):
        return None
    return reader.parts


def _bounds(data: bytes | None) -> tuple | None:
    xy = [p[:2] for _, points in _parts(data) or [] for p in points if p[0] == p[0] and p[1] == p[1]]
    if not xy:
        return None
    xs, ys = zip(*xy, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


#: A little-endian point without further dimensions.
POINT_BYTES, POINT_HEAD = 21, b"\x01\x01\x00\x00\x00"


@F.pandas_udf(ENVELOPE)
def _envelopes(wkb: pd.Series) -> pd.DataFrame:
    """Points are decoded all at once, other geometries one by one."""
    out = np.full((len(wkb), 4), np.nan)
    plain = np.array([x is not None and len(x) == POINT_BYTES and bytes(x[:5]) == POINT_HEAD for x in wkb], bool)
    if plain.any():
        packed = np.frombuffer(b"".join(bytes(x) for x in wkb[plain]), np.uint8).reshape(-1, POINT_BYTES)
        xy = packed[:, 5:].copy().view("<f8")
        xy[np.isnan(xy).any(1)] = np.nan
        out[plain] = np.concatenate([xy, xy], 1)
    for k in np.flatnonzero(~plain).tolist():
        out[k] = _bounds(wkb.iloc[k]) or np.nan
    rows = pd.DataFrame(out, columns=["xmin", "ymin", "xmax", "ymax"])
    return rows.astype(object).where(rows.notna(), None)


def envelope(wkb: Column | str) -> Column:
    """struct<xmin, ymin, xmax, ymax>; null where the bytes can't be read (types 1 to 7, Z, M, SRID, both byte orders)."""
    e = _envelopes(_col(wkb))
    return F.when(e["xmin"].isNotNull(), e)


def intersects(box: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Boxes that touch intersect; an unknown box does."""
    x0, y0, x1, y1 = bbox
    apart = (box["xmax"] < x0) | (box["xmin"] > x1) | (box["ymax"] < y0) | (box["ymin"] > y1)
    return F.coalesce(~apart, F.lit(True))


def _turned(kind: int, points: list[tuple]) -> list[tuple]:
    """A ring from its smallest point in the smaller direction; other parts as they are."""
    if kind != 3 or len(points) < 2 or points[0] != points[-1]:
        return points
    ring, ways = points[:-1], []
    for way in (ring, ring[::-1]):
        k = way.index(min(way))
        ways.append(way[k:] + way[:k])
    return min(ways)


def _same(a: bytes | None, b: bytes | None) -> bool:
    if a is None or b is None or a == b:
        return a == b
    x, y = _parts(a), _parts(b)
    if x is None or y is None or [(k, len(p)) for k, p in x] != [(k, len(p)) for k, p in y]:
        return False
    for (kind, p), (_, q) in zip(x, y, strict=True):
        if np.allclose(_turned(kind, p), _turned(kind, q), TOLERANCE, TOLERANCE):
            continue
        # The smallest point may be another one within the tolerance: any start and direction will do then.
        closed = kind == 3 and len(p) > 1 and p[0] == p[-1] and q[0] == q[-1]
        ring, other = np.array(p[:-1]), np.array(q[:-1])
        starts = np.flatnonzero(np.isclose(other, ring[:1], TOLERANCE, TOLERANCE).all(1)).tolist() if closed else []
        if not any(np.allclose(ring, np.roll(way, -s, 0), TOLERANCE, TOLERANCE) for k in starts for way, s in ((other, k), (other[::-1], len(other) - 1 - k))):
            return False
    return True


@F.pandas_udf(T.BooleanType())
def _same_shapes(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_same(None if x is None else bytes(x), None if y is None else bytes(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


SIGNATURE = T.StructType(
    [T.StructField(x, T.DoubleType()) for x in ("xmin", "ymin", "xmax", "ymax")] + [T.StructField("parts", T.LongType()), T.StructField("points", T.LongType()), T.StructField("kinds", T.StringType())]
)


@F.pandas_udf(SIGNATURE)
def _signatures(wkb: pd.Series) -> pd.DataFrame:
    rows = []
    for x in wkb:
        parts = _parts(None if x is None else bytes(x)) or []
        bounds = _bounds(None if x is None else bytes(x)) or (None,) * 4
        rows.append((*bounds, len(parts), sum(len(p) for _, p in parts), ",".join(str(k) for k, _ in parts[:64])))
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax", "parts", "points", "kinds"])


def signature(wkb: Column | str) -> Column:
    """What equal shapes have nearly or wholly in common: the envelope, and the numbers of parts and points and their kinds."""
    return _signatures(_col(wkb))


def same_bytes(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def same_shape(a: Column, b: Column) -> Column:
    """Equal bytes, or the same parts with coordinates within ``TOLERANCE``, wherever rings start and however they run."""
    return a.eqNullSafe(b) | _same_shapes(a, b)


def repair_drift(before: Column, after: Column, length_change: Column, area_change: Column, boundary: Column) -> Column:
    """How far a repaired geometry moved: the largest of envelope, length and area-per-boundary change."""
    sides = [F.abs(before[k] - after[k]) for k in ("xmin", "ymin", "xmax", "ymax")]
    area = F.when(boundary > 0, F.abs(area_change) / boundary).otherwise(F.sqrt(F.abs(area_change)))
    return F.greatest(*sides, F.abs(length_change), area)
