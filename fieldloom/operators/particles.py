"""Region culls and cell deposits of particles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.config import Grid, Region
from .projection import settle

AXES = "xyz"


def around(df: DataFrame, center: tuple[float, ...], box: float) -> DataFrame:
    """Positions moved to the image nearest to center."""
    return df.withColumns({a: S.lit(c) + S.min_image(F.col(a) - S.lit(c), box) for a, c in zip(AXES, center, strict=True)})


def cull(df: DataFrame, region: Region, box: float, support: Column | None = None) -> DataFrame:
    """Particles of a region, moved to the image nearest to its centre. A radius over 0 makes it a sphere. support:
    how far a particle reaches, as twice its smoothing length; none: its centre alone counts. Bounds are inclusive.

    A filter works an expression out wherever it stands, and code of over 8,000 bytes is never compiled, so all particles
    pass a loose test of each axis that names a place once; the exact one is for those that it leaves."""
    reach = S.lit(region.margin) + (support if support is not None else S.lit(0))
    wide = [F.abs(S.lit(region.radius if region.radius > 0 else s / 2) + reach) * S.lit(1 + 1e-9) + S.lit(1e-9 * box) for s in region.size]
    df = settle(df.where(reduce(lambda p, q: p & q, [S.lit(box / 2) - F.abs(F.abs(F.col(a) - S.lit(c)) - S.lit(box / 2)) <= r for a, c, r in zip(AXES, region.center, wide, strict=True)])))
    delta = [S.min_image(F.col(a) - S.lit(c), box) for a, c in zip(AXES, region.center, strict=True)]
    if region.radius > 0:
        d2 = sum((d * d for d in delta[1:]), delta[0] * delta[0])
        keep = d2 <= (S.lit(region.radius) + reach) * (S.lit(region.radius) + reach)
    else:
        keep = reduce(lambda p, q: p & q, [F.abs(d) <= S.lit(s / 2) + reach for d, s in zip(delta, region.size, strict=True)])
    return around(df.where(keep), region.center, box)


def deposit(df: DataFrame, grid: Grid, box: float, sums: dict[str, Column], h: str = "h") -> DataFrame:
    """Sparse cube (ix, iy, iz, sums): each column of `sums` weighted with the kernel at the cell's centre. h is at least
    half the smallest cell; particles without h go. Partial sums are made before the one shuffle, on the cell."""
    cell, low = grid.cell, grid.low
    df = around(df.where(F.col(h) > 0), grid.center, box).withColumn("__h", F.greatest(F.col(h), S.lit(min(cell) / 2)))
    for a, c, s in zip(AXES, grid.center, grid.size, strict=True):
        df = df.where(F.abs(F.col(a) - S.lit(c)) <= S.lit(s / 2) + 2 * F.col("__h"))
    index = {}
    for a, lo, s, n in zip(AXES, low, cell, grid.shape, strict=True):
        at = F.col(a) - S.lit(lo)
        first = F.greatest(F.floor((at - 2 * F.col("__h")) / S.lit(s)), F.lit(0))
        last = F.least(F.floor((at + 2 * F.col("__h")) / S.lit(s)), F.lit(n - 1))
        index[a] = (first, last)
    df = df.where(reduce(lambda p, q: p & q, [f <= t for f, t in index.values()]))
    for a, (f, t) in index.items():
        df = df.withColumn(f"i{a}", F.explode(F.sequence(f, t)))
    delta = [F.col(a) - (S.lit(lo) + (F.col(f"i{a}") + S.lit(0.5)) * S.lit(s)) for a, lo, s in zip(AXES, low, cell, strict=True)]
    df = df.withColumn("__r", F.sqrt(sum((d * d for d in delta[1:]), delta[0] * delta[0]))).where(F.col("__r") < 2 * F.col("__h"))
    df = df.withColumn("__w", S.kernel(F.col("__r"), F.col("__h")))
    return df.groupBy(*(F.col(f"i{a}").cast("int").alias(f"i{a}") for a in AXES)).agg(*(F.sum(v * F.col("__w")).alias(k) for k, v in sums.items()))


def grid_rows(spark: SparkSession, grids: list[Grid]) -> DataFrame:
    """A table of grids held in code: grid, center_x.., size_x.., n_x.."""
    rows = [(g.name, *map(float, g.center), *map(float, g.size), *map(int, g.shape)) for g in grids]
    return spark.createDataFrame(rows, "grid string, " + ", ".join(f"{n}_{a} {kind}" for n, kind in (("center", "double"), ("size", "double"), ("n", "int")) for a in AXES))


def _least_cell() -> Column:
    return F.least(*(F.col(f"size_{a}") / F.col(f"n_{a}") for a in AXES))


def deposit_grids(df: DataFrame, grids: DataFrame, box: float, sums: dict[str, Column], h: str = "h", cells: int = 16) -> DataFrame:
    """deposit() on every grid of a table (as of grid_rows) in one pass: (grid, ix, iy, iz, sums).

    Particles and grids meet by an equi-join: a particle lies in one cell of the box, of a size that its reach does not
    exceed (cells double from level to level), and a grid lists the cells of each level that hold what can touch it,
    across the faces of the box, too. Sums are made before the one shuffle, on (grid, cell). Rows with the same grid name
    add up; a grid with a null or without cells takes nothing. Places are within the box."""
    top = max(0, (cells - 1).bit_length())
    kept = grids.select("grid", *(f"{n}_{a}" for n in ("center", "size", "n") for a in AXES)).dropna()
    kept = kept.where(reduce(lambda p, q: p & q, [(F.col(f"n_{a}") > 0) & (F.col(f"size_{a}") > 0) for a in AXES]))
    near = kept.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    edge = S.lit(box / cells) * F.pow(S.lit(2), F.col("level"))
    last = F.floor(F.lit(cells - 1) / F.pow(S.lit(2), F.col("level"))).cast("int")
    for i, a in enumerate(AXES):
        near = near.withColumn(f"c{i}", F.explode(F.sequence(F.lit(0), last)))
        # The cell's middle may lie beyond half a box away only on the highest levels, where a cell is the whole box.
        off = F.abs(S.min_image((F.col(f"c{i}") + S.lit(0.5)) * edge - F.col(f"center_{a}"), box))
        near = near.where((F.col("level") == top) | (off <= F.col(f"size_{a}") / 2 + edge / 2 + F.greatest(edge, _least_cell()) + S.lit(1e-9 * box)))
    level = F.least(F.greatest(F.ceil(F.log2(2 * F.col(h) / S.lit(box / cells))), F.lit(0)), F.lit(top)).cast("int")
    placed = df.where((F.col(h) > 0) & reduce(lambda p, q: p & q, [F.col(a).isNotNull() for a in AXES])).withColumn("level", level)
    edge = S.lit(box / cells) * F.pow(S.lit(2), F.col("level"))
    placed = placed.withColumns({f"c{i}": F.least(F.greatest(F.floor(F.col(a) / edge), F.lit(0)), F.floor(F.lit(cells - 1) / F.pow(S.lit(2), F.col("level")))).cast("int") for i, a in enumerate(AXES)})
    met = placed.join(near, ["level", "c0", "c1", "c2"]).withColumn("__h", F.greatest(F.col(h), _least_cell() / 2))
    met = met.withColumns({a: F.col(f"center_{a}") + S.min_image(F.col(a) - F.col(f"center_{a}"), box) for a in AXES})
    met = met.where(reduce(lambda p, q: p & q, [F.abs(F.col(a) - F.col(f"center_{a}")) <= F.col(f"size_{a}") / 2 + 2 * F.col("__h") for a in AXES]))
    step = {a: F.col(f"size_{a}") / F.col(f"n_{a}") for a in AXES}
    low = {a: F.col(f"center_{a}") - F.col(f"size_{a}") / 2 for a in AXES}
    ends = {a: [F.floor((F.col(a) - low[a] + way * 2 * F.col("__h")) / step[a]) for way in (-1, 1)] for a in AXES}
    met = met.withColumns({f"__f{a}": F.greatest(f, F.lit(0)) for a, (f, _) in ends.items()} | {f"__t{a}": F.least(t, F.col(f"n_{a}") - 1) for a, (_, t) in ends.items()})
    met = met.where(reduce(lambda p, q: p & q, [F.col(f"__f{a}") <= F.col(f"__t{a}") for a in AXES]))
    for a in AXES:
        met = met.withColumn(f"i{a}", F.explode(F.sequence(f"__f{a}", f"__t{a}")))
    delta = [F.col(a) - (low[a] + (F.col(f"i{a}") + S.lit(0.5)) * step[a]) for a in AXES]
    met = met.withColumn("__r", F.sqrt(sum((d * d for d in delta[1:]), delta[0] * delta[0]))).where(F.col("__r") < 2 * F.col("__h"))
    met = met.withColumn("__w", S.kernel(F.col("__r"), F.col("__h")))
    return met.groupBy("grid", *(F.col(f"i{a}").cast("int").alias(f"i{a}") for a in AXES)).agg(*(F.sum(v * F.col("__w")).alias(k) for k, v in sums.items()))


def gas_fields() -> dict[str, Column]:
    """What each field of a gas cube sums; density doubles as the weight of the means."""
    m = F.col("mass")
    return {"gas_density": m, "mass_weight": m, "temperature": m * F.col("temperature"), "metallicity": m * F.col("metallicity"), "hii_density": m * F.col("hii"), "vx": m * F.col("vx"), "vy": m * F.col("vy"), "vz": m * F.col("vz")}


def intensive(cube: DataFrame, fields: tuple[str, ...] = ("temperature", "metallicity", "vx", "vy", "vz")) -> DataFrame:
    """Sums divided by mass_weight where that is positive."""
    return cube.withColumns({f: F.when(F.col("mass_weight") > 0, F.col(f) / F.col("mass_weight")).otherwise(F.col(f)) for f in fields})


#: What a particle gets as h that has fewer than k others, unless a largest h is given.
LONELY = 1e15
#: Levels of cells that are counted at a time, besides the first.
LADDER = 8


def neighbour_h(df: DataFrame, k: int, key: str = "pid", h_max: float | None = None, h_min: float = 0.0, within: str | None = None, levels: int = 24, box: float | None = None) -> DataFrame:
    """(key, h): the distance to the k-th nearest other particle, at most h_max and at least h_min. box: the side of a
    periodic box that holds all places; distances are then those to the nearest image. Without it nothing is periodic.
    within: a column, such as the subfile, in which neighbours must agree.

    The particles' box is halved `levels` times along each axis, by default down to what 32-bit coordinates tell apart. A
    particle's node is the smallest cell around it that holds more than k particles, so nodes are small where particles are
    dense. The k-th distance inside the node bounds the one sought; a second join looks into the cells of the node's size
    that a sphere of this radius meets. Both joins are equi-joins on cells, and of the distances only the k least are
    kept, so no group is ever held in memory. Small jobs count the full cells of a few levels at a time, from the whole box
    on, until none is full; only levels that hold nodes are then joined. Joins are by merge: a side that happens to be
    small need not pass through the driver. Particles at one place are one row that counts as many. Whoever has fewer than
    k others gets LONELY; nobody is left out. A place with a null coordinate has no neighbours.
    """
    alike = ["__in"] if within else []
    points = df.select(F.col(key).alias("__key"), *(F.col(within).alias("__in") for _ in alike), *AXES)
    low, side = [f"__low_{a}" for a in AXES], F.col("__side")
    corner = points.agg(*(F.min(a).alias(n) for a, n in zip(AXES, low, strict=True)), F.greatest(*(F.max(a) - F.min(a) for a in AXES)).alias("__side"))
    cells = 1 << levels

    def cell(x: Column, n: str) -> Column:
        return F.least(F.greatest(F.floor(F.coalesce(F.try_divide(x - F.col(n), side), S.lit(0)) * S.lit(cells)), F.lit(0)), F.lit(cells - 1))

    def above(prefix: str) -> list[Column]:
        return [F.expr(f"shiftright({prefix}{a}, {levels} - level)").alias(f"n{a}") for a in AXES]

    fine, node, place = [f"c{a}" for a in AXES], [f"n{a}" for a in AXES], [*alike, *AXES]
    spots = points.where(reduce(lambda p, q: p & q, [F.col(a).isNotNull() for a in AXES])).groupBy(*place).agg(F.count(F.lit(1)).alias("m"))

    def celled(df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(corner)).withColumns({c: cell(F.col(a), n) for c, a, n in zip(fine, AXES, low, strict=True)})  # one row

    def tree(first: int, last: int) -> DataFrame:
        ladder = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level")
        return celled(spots).select(*place, "m", *fine, ladder).select(*place, "m", "level", *above("c"))

    def counted(of: DataFrame) -> DataFrame:
        return of.groupBy(*alike, "level", *node).agg(F.sum("m").alias("n"))

    lowest, highest, first = None, 0, 0
    while True:  # at most levels / LADDER + 1 jobs, of a few numbers each
        last = min(first + LADDER, levels)
        found = counted(tree(first, last)).groupBy("level").agg(F.max("n").alias("most"), F.min("n").alias("least")).collect()
        highest = max([highest, *(r["level"] for r in found if r["most"] > k)])
        lowest = min([r["level"] for r in found if r["least"] <= k], default=None) if lowest is None else lowest
        if highest < last or last == levels:
            break
        first = last + 1
    # Every cell above the first level that has one with few particles is full, so nodes begin one level above it.
    nodes = tree(highest if lowest is None else max(lowest - 1, 0), highest)
    full = counted(nodes).where(F.col("n") > k).drop("n")
    placed = celled(nodes.join(full.hint("merge"), [*alike, "level", *node]).groupBy(*place).agg(F.max("level").alias("level")))
    others = nodes.select(*alike, "level", *node, "m", *(F.col(a).alias(f"o{a}") for a in AXES))

    def nearest(asks: DataFrame, per: list[str], bounded: bool) -> DataFrame:
        """per, reach: the squared distance to the k-th other particle among those in the cells asked for."""
        d2 = sum((F.pow(F.col(f"q{a}") - F.col(f"o{a}"), 2) for a in "yz"), F.pow(F.col("qx") - F.col("ox"), 2))
        own = reduce(lambda p, q: p & q, [F.col(f"q{a}") == F.col(f"o{a}") for a in AXES])
        near = asks.join(others.hint("merge"), [*alike, "level", *node])
        if box is None:  # the question is the place itself
            near = near.withColumns({f"q{a}": F.col(a) for a in AXES})
        elif bounded:  # of the images of another particle, the nearest alone
            near = near.where(reduce(lambda p, q: p & q, [(F.col(f"q{a}") - F.col(f"o{a}") > S.lit(-box / 2)) & (F.col(f"q{a}") - F.col(f"o{a}") <= S.lit(box / 2)) for a in AXES]))
        near = near.withColumn("d2", d2).where(F.col("d2") <= F.col("reach")) if bounded else near.withColumn("d2", d2)
        near = near.select(*per, "d2", (F.col("m") - own.cast("long")).alias("m")).where("m > 0")
        order = Window.partitionBy(*per).orderBy("d2")
        first = near.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
        seen = first.withColumn("__seen", F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return seen.where(F.col("__seen") >= k).groupBy(*per).agg(F.min("d2").alias("reach"))

    here = [] if box is None else [F.col(a).alias(f"q{a}") for a in AXES]
    # A place asks in one node alone, so its distances are ranked where the join put them, without another shuffle.
    bound = nearest(placed.select(*place, *here, "level", *above("c")), [*alike, "level", *node, *AXES], False)
    asks = bound.drop(*node).crossJoin(F.broadcast(corner)).select("*", *here)  # one row
    if box is not None:
        # A sphere that leaves the box asks again from the place's images on the other sides, as far as it meets the
        # particles' own extent; places are not copied, only questions near a face are.
        for a, n in zip(AXES, low, strict=True):
            moved = F.explode(F.array(F.col(a) - S.lit(box), F.col(a), F.col(a) + S.lit(box)))
            asks = asks.withColumn(f"q{a}", moved).where((F.col(f"q{a}") + F.sqrt("reach") * S.lit(1 + 1e-12) >= F.col(n)) & (F.col(f"q{a}") - F.sqrt("reach") * S.lit(1 + 1e-12) <= F.col(n) + side))
    asked = AXES if box is None else [f"q{a}" for a in AXES]
    r = F.sqrt("reach") * S.lit(1 + 1e-12)
    for a, q, n in zip(AXES, asked, low, strict=True):
        ends = [cell(F.col(q) + way * r, n) for way in (-1, 1)]
        asks = asks.withColumns({f"__f{a}": ends[0], f"__t{a}": ends[1]})
        asks = asks.withColumn(f"n{a}", F.explode(F.expr(f"sequence(shiftright(__f{a}, {levels} - level), shiftright(__t{a}, {levels} - level))")))
    exact = nearest(asks.select(*dict.fromkeys([*place, *asked]), "level", *node, "reach"), place, True).select(*place, F.sqrt("reach").alias("__r"))
    h = F.coalesce(F.col("__r"), S.lit(LONELY))
    h = h if h_max is None else F.least(h, S.lit(h_max))
    return points.join(exact.hint("merge"), place, "left").select(F.col("__key").alias(key), F.greatest(h, S.lit(h_min)).alias("h"))


def extent(df: DataFrame, h: str | None = "h") -> DataFrame:
    """One row: number of particles, bounding box (x_min, x_max, ...) and h_max; h None: without h_max."""
    ends = [f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    return df.agg(F.count(F.lit(1)).alias("n"), *ends, *([F.max(h).alias("h_max")] if h else []))


def h_statistics(df: DataFrame, h: str = "h") -> DataFrame:
    """One row: least, most and mean smoothing length."""
    return df.agg(F.min(h).alias("h_min"), F.max(h).alias("h_max"), F.avg(h).alias("h_mean"))


def loaded(df: DataFrame, region: Region, box: float, support: Column | None = None) -> DataFrame:
    """One row: how many particles there are and how many of them a region takes."""
    return df.agg(F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(cull(df, region, box, support).agg(F.count(F.lit(1)).alias("inside"))))  # one row each


def scale_h(df: DataFrame, factor: float, h: str = "h") -> DataFrame:
    """Smoothing lengths times a factor, as for a smoother or a sharper picture; 1 changes nothing."""
    return df if factor == 1 else df.withColumn(h, F.col(h) * S.lit(factor))


def subsample(df: DataFrame, most: int, key: str = "pid") -> DataFrame:
    """At most so many particles, always the same ones: those of the lowest md5 of their key."""
    return df.orderBy(F.md5(F.encode(F.col(key).cast("string"), "UTF-8")), key).limit(most)
