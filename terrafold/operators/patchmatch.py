"""Nearest-neighbour fields of rasters: rounds of propagation and random search as joins on pixel keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written


#: How far a found place travels in one round.
JUMPS = (1, 4, 16)


def patches(raster: DataFrame, values: list[str], by: list[str], reach: int = 1) -> DataFrame:
    """``by, v, u, patch``: the values around each pixel, row by row; cells that the raster lacks are null."""
    size = 2 * reach + 1
    steps = F.array(*(F.struct(F.lit(dv).alias("dv"), F.lit(du).alias("du"), F.lit((dv + reach) * size + du + reach).alias("k")) for dv in range(-reach, reach + 1) for du in range(-reach, reach + 1)))
    spread = raster.withColumn("_o", F.explode(steps))
    spread = spread.select(*by, (F.col("v") - F.col("_o.dv")).alias("v"), (F.col("u") - F.col("_o.du")).alias("u"), F.col("_o.k").alias("_k"), *values)
    cells = [F.max(F.when(F.col("_k") == k, F.col(x))).alias(f"_{x}{k}") for k in range(size * size) for x in values]
    wide = spread.groupBy(*by, "v", "u").agg(F.max((F.col("_k") == size * size // 2).cast("int")).alias("_own"), *cells).where("_own = 1")
    return wide.select(*by, "v", "u", F.array(*(F.col(f"_{x}{k}").cast("double") for k in range(size * size) for x in values)).alias("patch"))


def patch_cost(a: Column, b: Column) -> Column:
    """Mean squared difference over the cells that both patches have."""
    both = F.filter(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda x: x.isNotNull())
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / F.size(both)


def drawn(what: list, low: Column, width: int) -> Column:
    """A place from ``low`` on, drawn by the hash of ``what``: the same however rows are dealt out, or run again."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in what))), 1, 8), 16, 10).cast("long")
    return low + h % width


def nearest_field(target: DataFrame, source: DataFrame, values: list[str], by: list[str] | None = None, reach: int = 1, rounds: int = 5, seed: int = 0) -> DataFrame:
    """``by, v, u, sv, su, cost``: for each target pixel a source place whose patch is most alike, of those that were tried.

    A round tries what the pixels 1, 4 and 16 away in four directions have found, moved by as much, and random places in rings that halve around the pixel's own (at first around
    itself), all by one equi-join with the source's patches; of equal costs the smallest place stays. Each round is written, so lost
    executors repeat it alone. Pixels for which no place was in the source have nulls. Empty rasters give no rows.
    """
    by, key = by or [], [*(by or []), "v", "u"]
    mine = written(patches(target, values, by, reach), "patches")
    theirs = written(patches(source, values, by, reach).select(*by, F.col("v").alias("sv"), F.col("u").alias("su"), F.col("patch").alias("_b")), "patches")
    box = theirs.agg(*(F.max(c) - F.min(c) for c in ("sv", "su"))).first()
    radius, radii = max(box[0] or 0, box[1] or 0), []
    while radius >= 1:
        radii.append(int(radius))
        radius //= 2
    field = mine.select(*key, *(F.lit(None).cast("long").alias(c) for c in ("sv", "su")), F.lit(None).cast("double").alias("cost"))
    sides = F.array(*(F.struct(F.lit(far * dv).alias("dv"), F.lit(far * du).alias("du")) for far in JUMPS for dv, du in ((-1, 0), (0, -1), (0, 1), (1, 0))))
    for n in range(rounds):
        middle = [F.coalesce(f"s{c}", c) for c in ("v", "u")]
        tries = F.array(*(F.struct(*(drawn([seed, n, r, c, F.col("v"), F.col("u")], m - r, 2 * r + 1).cast("long").alias(f"s{c}") for c, m in zip("vu", middle, strict=True))) for r in [*radii, 0]))
        random = field.select(*key, F.explode(tries).alias("_t")).select(*key, "_t.sv", "_t.su")
        beside = field.where("sv is not null").withColumn("_o", F.explode(sides)).select(*by, *((F.col(c) + F.col(f"_o.d{c}")).alias(c) for c in ("v", "u")), *((F.col(f"s{c}") + F.col(f"_o.d{c}")).cast("long").alias(f"s{c}") for c in ("v", "u")))
        tried = random.unionByName(beside).distinct().join(mine, key).join(theirs, [*by, "sv", "su"]).select(*key, "sv", "su", patch_cost(F.col("patch"), F.col("_b")).alias("cost"))
        best = tried.unionByName(field.where("sv is not null")).groupBy(*key).agg(F.min(F.struct("cost", "sv", "su")).alias("_m"))
        field = written(mine.select(*key).join(best, key, "left").select(*key, "_m.sv", "_m.su", "_m.cost"), "field")
    return field
