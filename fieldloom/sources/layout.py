"""Snapshots laid out so that a region reads little of them.

Particles are sorted by a Morton key, the interleaved bits of their cell in a grid of 2^BITS cells a side, in files of
key ranges. Particles near each other are so in the same row groups, whose statistics of key and coordinates Parquet
keeps. A region becomes a predicate over key and coordinates alone, without arithmetic, which Spark hands to the reader:
row groups that cannot hold a particle of the region are skipped. Across the faces of a periodic box it is a union.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.particles import AXES, cull
from ..plans.config import Region

#: Bits of a key for each axis.
BITS = 16
#: Key ranges in a region's predicate, at most; more would cost more to test than they skip.
RANGES = 32


def _spread(x: Column) -> Column:
    """Bits of a cell number, of up to 16 bits, each followed by two zeros. A number and itself shifted share no bits here, so
    a product stands for both: naming x twice in each step would work it out 16 times."""
    for shift, mask in ((16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        x = (x * F.lit(1 + (1 << shift))).bitwiseAND(F.lit(mask))
    return x


def morton(columns: list[Column], box: float, bits: int = BITS) -> Column:
    """The key of a place; coordinates outside the box count as at its faces, a null one has no key. For up to 16 bits."""
    cell = lambda x: F.least(F.greatest(F.floor(x / S.lit(box) * S.lit(1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
    wide = [_spread(cell(x)) for x in columns]
    key = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(w, i) for i, w in enumerate(wide)])
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in columns]), key)


def write_layout(df: DataFrame, path: str, box: float, files: int | None = None, row_group: int = 8 << 20, reach: str | None = "h") -> None:
    """Particles (x, y, z and any columns) as files of key ranges, sorted within, and a row of facts beside them: the box
    and the largest reach, 2 times the column `reach`. The ranges come from a sample, so a dense place has more files; a
    rerun writes the same rows. row_group: bytes of a row group, about."""
    most = F.max(2 * F.col(reach)) if reach else F.lit(0.0)
    keyed = df.withColumn("morton", morton([F.col(a) for a in AXES], box))
    keyed = keyed.repartitionByRange(files, "morton", *AXES) if files else keyed.repartitionByRange("morton", *AXES)
    keyed.sortWithinPartitions("morton").write.mode("overwrite").option("parquet.block.size", row_group).parquet(f"{path}/particles")
    facts = df.sparkSession.read.parquet(f"{path}/particles").agg(F.coalesce(most, S.lit(0)).cast("double").alias("reach")).select("reach", S.lit(box).alias("box"))
    facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")


def _code(cell: tuple[int, ...], bits: int) -> int:
    return sum(((cell[i] >> b) & 1) << (3 * b + i) for b in range(bits) for i in range(3))


def key_ranges(low: tuple[float, ...], high: tuple[float, ...], box: float, bits: int = BITS, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys that hold every place between two corners: the cells of the finest level of which the corners span no
    more than `most`, as ranges of keys; those that follow on each other are joined."""
    best = [(0, (1 << 3 * bits) - 1)]
    for level in range(1, bits + 1):
        ends = [[min(max(int(v / box * (1 << level)), 0), (1 << level) - 1) for v in (lo, hi)] for lo, hi in zip(low, high, strict=True)]
        count = (ends[0][1] - ends[0][0] + 1) * (ends[1][1] - ends[1][0] + 1) * (ends[2][1] - ends[2][0] + 1)
        if count > 8 * most:
            break
        codes = sorted(_code(c, level) for c in product(*(range(a, b + 1) for a, b in ends)))
        runs: list[list[int]] = []
        for k in codes:
            if runs and runs[-1][1] + 1 == k:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        if len(runs) > most:
            break
        rest = 3 * (bits - level)
        best = [(a << rest, ((b + 1) << rest) - 1) for a, b in runs]
    return best


def boxes(region: Region, box: float, reach: float) -> list[tuple[tuple[float, ...], tuple[float, ...]]]:
    """The region with what reaches into it as boxes inside the periodic box: one, or up to eight across its faces."""
    axes = []
    for c, s in zip(region.center, region.size, strict=True):
        half = (region.radius if region.radius > 0 else s / 2) + region.margin + reach
        half *= 1 + 1e-12
        if 2 * half >= box:
            axes.append([(0.0, box)])
            continue
        lo, hi = (c - half) % box, (c + half) % box
        axes.append([(lo, hi)] if lo <= hi else [(lo, box), (0.0, hi)])
    return [(tuple(a[0] for a in p), tuple(a[1] for a in p)) for p in product(*axes)]


def region_filter(region: Region, box: float, reach: float = 0.0, bits: int = BITS) -> Column:
    """Whether a laid-out particle may be in the region: comparisons of columns with numbers only, for the reader. Particles
    at the faces of the box or beyond them are let through to the exact test."""
    parts = []
    for low, high in boxes(region, box, reach):
        keys = reduce(lambda p, q: p | q, [(F.col("morton") >= F.lit(a)) & (F.col("morton") <= F.lit(b)) for a, b in key_ranges(low, high, box, bits)])
        edges = [F.col(a) >= S.lit(lo) for a, lo in zip(AXES, low, strict=True) if lo > 0] + [F.col(a) <= S.lit(hi) for a, hi in zip(AXES, high, strict=True) if hi < box]
        parts.append(reduce(lambda p, q: p & q, edges, keys))
    return reduce(lambda p, q: p | q, parts)


def read_region(spark: SparkSession, path: str, region: Region, support: Column | None = None) -> DataFrame:
    """cull() of a laid-out snapshot, with the columns written. support: as for cull; it must not be over the largest reach
    in the layout's facts. An empty snapshot gives no rows."""
    facts = spark.read.parquet(f"{path}/facts").first()
    particles = spark.read.parquet(f"{path}/particles").where(region_filter(region, facts["box"], facts["reach"] if support is not None else 0.0))
    return cull(particles, region, facts["box"], support).drop("morton")
