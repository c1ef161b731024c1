"""A space-filling key of position, and boxes as intervals of it.

``zkey`` interleaves the bits of quantised latitude and longitude (Z-order), so
strikes that lie near each other have near keys and a file clustered by it has
row groups of small regions in both directions. A box is a few runs of keys:
its quadtree cells, refined until ``most`` runs cover it closely. The runs are
added to the exact box as ``OR`` of ranges, which Parquet row groups and pages
are skipped by; they never change which rows qualify.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZKEY = "zkey"
#: Bits of each coordinate: cells of about 300 by 600 m at the equator.
BITS = 16
#: Runs of keys that a box is covered with.
RUNS = 24


def _cell(value: Column, low: float, span: float) -> Column:
    cells = 1 << BITS
    return F.least(F.greatest(F.floor((value - low) / span * cells), F.lit(0)), F.lit(cells - 1)).cast("long")


def with_zkey(strikes: DataFrame) -> DataFrame:
    """``strikes`` with ``zkey``. In steps of named columns, so that each is computed once."""
    if ZKEY in strikes.columns:
        return strikes
    df = strikes.withColumns({"_zy": _cell(F.col("latitude"), -90.0, 180.0), "_zx": _cell(F.col("longitude"), -180.0, 360.0)})
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        df = df.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(F.col(c), shift)).bitwiseAND(F.lit(mask).cast("long")) for c in ("_zy", "_zx")})
    return df.withColumn(ZKEY, F.shiftleft("_zy", 1).bitwiseOR(F.col("_zx"))).drop("_zy", "_zx")


def zkey_of(lat: float, lon: float) -> int:
    """The key of one position, as ``with_zkey`` gives it."""
    y, x = _place(lat, -90.0, 180.0), _place(lon, -180.0, 360.0)
    return sum((y >> b & 1) << (2 * b + 1) | (x >> b & 1) << (2 * b) for b in range(BITS))


def _place(value: float, low: float, span: float) -> int:
    cells = 1 << BITS
    return min(max(math.floor((value - low) / span * cells), 0), cells - 1)


def runs_of_box(min_lat: float, max_lat: float, min_lon: float, max_lon: float, most: int = RUNS) -> list[tuple[int, int]]:
    """(first, last) key of runs that together hold every key of the box: at
    most ``most``, the quadtree cells with most of them outside refined first."""
    if min_lat > max_lat or min_lon > max_lon:
        return []
    y0, y1 = _place(min_lat, -90.0, 180.0), _place(max_lat, -90.0, 180.0)
    x0, x1 = _place(min_lon, -180.0, 360.0), _place(max_lon, -180.0, 360.0)

    def outside(y: int, x: int, size: int) -> int:
        """Cells of a square that are not in the box; its whole area if none is."""
        high = max(0, min(y + size - 1, y1) - max(y, y0) + 1)
        wide = max(0, min(x + size - 1, x1) - max(x, x0) + 1)
        return size * size - high * wide

    whole = 1 << BITS
    open_ = [(-outside(0, 0, whole), 0, 0, 0, whole)]  # waste, first key, y, x, size
    done: list[tuple[int, int]] = []
    while open_ and len(open_) + len(done) < 4 * most:
        waste, first, y, x, size = heapq.heappop(open_)
        if waste == 0 or size == 1:
            done.append((first, first + size * size - 1))
            continue
        half = size // 2
        for quarter, (dy, dx) in enumerate(((0, 0), (0, half), (half, 0), (half, half))):
            part = outside(y + dy, x + dx, half)
            if part < half * half:
                heapq.heappush(open_, (-part, first + quarter * half * half, y + dy, x + dx, half))
    cells = sorted(done + [(first, first + size * size - 1) for _, first, _, _, size in open_])
    runs = [cells[0]]
    for first, last in cells[1:]:
        if first == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], last)
        else:
            runs.append((first, last))
    while len(runs) > most:  # close the smallest gap
        k = min(range(len(runs) - 1), key=lambda i: runs[i + 1][0] - runs[i][1])
        runs[k:k + 2] = [(runs[k][0], runs[k + 1][1])]
    return runs


def in_box(strikes: DataFrame, min_lat: float | None = None, max_lat: float | None = None, min_lon: float | None = None,
           max_lon: float | None = None) -> DataFrame:
    """The strikes of a box; every bound optional and inclusive. Where the
    table has ``zkey``, its runs go with the exact bounds to the scan."""
    df = strikes
    for name, low, high in (("latitude", min_lat, max_lat), ("longitude", min_lon, max_lon)):
        if low is not None:
            df = df.where(F.col(name) >= low)
        if high is not None:
            df = df.where(F.col(name) <= high)
    bounds = [(-90.0 if min_lat is None else min_lat), (90.0 if max_lat is None else max_lat),
              (-180.0 if min_lon is None else min_lon), (180.0 if max_lon is None else max_lon)]
    runs = runs_of_box(*bounds)
    if ZKEY in strikes.columns and runs and runs != [(0, (1 << 2 * BITS) - 1)]:
        any_run = F.lit(False)
        for first, last in runs:
            any_run = any_run | F.col(ZKEY).between(first, last)
        df = df.where(any_run)
    return df
