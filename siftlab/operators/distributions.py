"""Distribution statistics of metric values in long form: one row per value with its group keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.operators.keys import null_safe_join
from siftlab.operators.ordinals import exact_quantiles, top_per_group
from siftlab.session import materialize

QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.50, "p75": 0.75, "p95": 0.95}


def basic_stats(df: DataFrame, by: list[str], value: str, approximate: bool = False) -> DataFrame:
    """min, p05, p25, median, mean, p75, p95, max, sample deviation (0 for one value) and n."""
    moments = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.coalesce(F.nanvl(F.stddev_samp(value), F.lit(0.0)), F.lit(0.0)).alias("stdev"),
    )
    if approximate:
        sketch = df.groupBy(*by).agg(F.percentile_approx(value, list(QUANTILES.values()), 10000).alias("_q"))
        quantiles = sketch.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(QUANTILES)])
    else:
        quantiles = exact_quantiles(df, by, value, QUANTILES)
    return null_safe_join(moments, quantiles, by)


def bin_count(n: Column, low: Column, high: Column, iqr: Column, lo: int = 5, hi: int = 50) -> Column:
    """Freedman-Diaconis bins clamped to [lo, hi]; square-root rule without spread, 1 without range."""
    width = 2 * iqr / F.pow(n, F.lit(1.0 / 3.0))
    wanted = F.when(iqr > 0, F.ceil((high - low) / width)).otherwise(F.ceil(F.sqrt(n)))
    clamped = F.greatest(F.lit(lo), F.least(F.lit(hi), wanted))
    return F.when((n <= 1) | (high <= low), 1).otherwise(clamped).cast("int")


def histogram_shape(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Bin count, range and width per group."""
    ends = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    quartiles = exact_quantiles(df, by, value, {"q25": 0.25, "q75": 0.75})
    shape = null_safe_join(ends, quartiles, by).withColumn(
        "bins", bin_count(F.col("n").cast("double"), F.col("lo"), F.col("hi"), F.col("q75") - F.col("q25"))
    )
    return shape.select(*by, "n", "lo", "hi", "bins", ((F.col("hi") - F.col("lo")) / F.col("bins")).alias("width"))


def bin_index(value: Column, lo: Column, hi: Column, bins: Column, width: Column) -> Column:
    """Zero-based bin; the last bin is closed and everything outside falls into the end bins."""
    inner = F.least(F.floor((value - lo) / F.when(width > 0, width)), bins - 1)
    return F.when((value <= lo) | (hi <= lo), 0).when(value >= hi, bins - 1).otherwise(inner).cast("int")


def histogram(df: DataFrame, by: list[str], value: str, shape: DataFrame | None = None) -> DataFrame:
    """Counts of all bins, empty ones included, with the bin edges.

    Values are counted per (group, bin) before anything is joined to the empty bins, so at most
    50 rows per group and task are shuffled. Pass ``shape`` (lo, hi, bins, width) for fixed bins.
    """
    if shape is None:
        # One row per group, used twice. As a written table its true size decides about a broadcast.
        shape = materialize(histogram_shape(df, by, value), "shape")
    placed = null_safe_join(df.where(F.col(value).isNotNull()), shape, by)
    index = bin_index(F.col(value), F.col("lo"), F.col("hi"), F.col("bins"), F.col("width"))
    counts = placed.groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = shape.select(
        *by, "lo", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")
    )
    return null_safe_join(edges, counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("edge"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def _density_frame(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Range, bin width and bandwidth ``h`` of the groups with three values and some spread."""
    shape = histogram_shape(df, by, value)
    spread = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.stddev_samp(value).alias("sd"))
    frame = null_safe_join(shape, spread, by).where((F.col("n") >= 3) & (F.col("sd") > 0) & (F.col("hi") > F.col("lo")))
    frame = frame.withColumn("h", 1.06 * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    return materialize(frame, "shape")


# Values whose kernels are added up at once.
KERNEL_ROWS = 1024


def density_curve(df: DataFrame, by: list[str], value: str, points: int = 240) -> DataFrame:
    """Gaussian kernel density on a grid over the range, scaled to expected counts per bin.

    Equal values are merged first; the kernels of the distinct values of a group are added up on
    its grid points batch by batch, so a batch sends one sum per point. Groups need three values
    and some spread.
    """
    frame = _density_frame(df, by, value).withColumn("_step", (F.col("hi") - F.col("lo")) / (points - 1))
    frame = materialize(frame.withColumn("_g", F.monotonically_increasing_id()), "grid")
    merged = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = null_safe_join(merged, frame, by).select(
        "_g", F.col(value).cast("double").alias("_v"), F.col("_c").cast("double").alias("_c"), "lo", "_step", "h"
    )

    def kernels(batches):
        import numpy as np
        import pandas as pd

        grid = np.arange(points)
        for batch in batches:
            for group, rows in batch.groupby("_g", sort=False):
                at = rows["lo"].iat[0] + grid * rows["_step"].iat[0]
                total = np.zeros(points)
                with np.errstate(all="ignore"):
                    for i in range(0, len(rows), KERNEL_ROWS):
                        part = rows.iloc[i : i + KERNEL_ROWS]
                        z = (at[None, :] - part["_v"].to_numpy()[:, None]) / part["h"].iat[0]
                        total += part["_c"].to_numpy() @ np.exp(-0.5 * z * z)
                yield pd.DataFrame({"_g": group, "point": grid.astype("int32"), "_mass": total})

    sums = placed.mapInPandas(kernels, "_g bigint, point int, _mass double").groupBy("_g", "point").agg(F.sum("_mass").alias("_mass"))
    norm = F.col("width") / (F.col("h") * F.sqrt(2 * F.pi()))
    return sums.join(frame, "_g").select(
        *by, "point", (F.col("lo") + F.col("point") * F.col("_step")).alias("x"), (F.col("_mass") * norm).alias("y")
    )


def binned_density_curve(df: DataFrame, by: list[str], value: str, points: int = 240, cells: int = 4) -> DataFrame:
    """``density_curve`` by linear binning: every value is shared by its two neighbours on a finer grid.

    The grid has ``cells`` steps between two points, so a group is shuffled as at most
    ``cells * (points - 1) + 2`` sums per task, whatever its number of values, and one convolution
    of these sums gives its curve. With n values, grid step d and bandwidth h, ``y`` differs from
    the exact curve by at most ``n * width / (h * sqrt(2 * pi)) * d ** 2 / (8 * h ** 2)``, the
    linear interpolation error of the kernel. Null values are left out and null keys are a group.
    """
    frame = _density_frame(df, by, value)
    frame = frame.withColumn("_d", (F.col("hi") - F.col("lo")) / (cells * (points - 1)))
    placed = null_safe_join(df.where(F.col(value).isNotNull()), frame, by)
    at = (F.col(value) - F.col("lo")) / F.col("_d")
    share = at - F.floor(at)
    parts = F.array(
        F.struct(F.floor(at).cast("int").alias("cell"), (1 - share).alias("w")),
        F.struct((F.floor(at) + 1).cast("int").alias("cell"), share.alias("w")),
    )
    grid = placed.select(*by, F.inline(parts)).groupBy(*by, "cell").agg(F.sum("w").alias("w"))
    # Bounded by the grid, so a group fits one row.
    rows = grid.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cell", "w"))).alias("_grid"))
    rows = null_safe_join(rows, frame, by)

    def mass(point: Column) -> Column:
        def add(total: Column, part: Column) -> Column:
            z = (point * cells - part["cell"]) * F.col("_d") / F.col("h")
            return total + part["w"] * F.exp(-0.5 * z * z)

        return F.aggregate("_grid", F.lit(0.0), add)

    curve = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda p: F.struct(p.alias("point"), mass(p).alias("mass")))
    norm = F.col("width") / (F.col("h") * F.sqrt(2 * F.pi()))
    return rows.select(*by, "lo", (F.col("_d") * cells).alias("_step"), norm.alias("_norm"), F.inline(curve)).select(
        *by, "point", (F.col("lo") + F.col("point") * F.col("_step")).alias("x"), (F.col("mass") * F.col("_norm")).alias("y")
    )


def fraction_sanity(df: DataFrame, by: list[str], value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts inside and outside the expected range and the mean of what lies inside."""
    inside = F.col(value).between(low, high)
    return df.groupBy(*by).agg(
        F.count_if(inside).alias("n_in_range"),
        F.count_if(~inside).alias("n_out_of_range"),
        F.avg(F.when(inside, F.col(value))).alias("mean_in_range"),
    )


def modal_label(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The most frequent label per group (the smaller label in ties) with its count."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(
        F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col(label))).alias("_m")
    ).select(*by, f"_m.{label}", "_m.n")


def extremes(df: DataFrame, by: list[str], value: str, tie: str, example: list[str]) -> DataFrame:
    """Example rows of the smallest and the largest value per group."""
    shown = F.struct(F.col(value), *[F.col(c) for c in example])
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min_by(shown, F.struct(F.col(value), F.col(tie))).alias("at_min"),
        F.min_by(shown, F.struct(-F.col(value), F.col(tie))).alias("at_max"),
    )


def unparsed_examples(df: DataFrame, by: list[str], parsed: str, tie: str, n: int = 10) -> DataFrame:
    """Up to ``n`` rows per group whose value could not be parsed (a report of examples)."""
    return top_per_group(df.where(F.col(parsed).isNull()), by, tie, n)


def key_sets(df: DataFrame, metrics: str) -> DataFrame:
    """Count of each sorted set of metric keys."""
    keys = F.array_sort(F.map_keys(metrics))
    return df.groupBy(F.array_join(keys, "+").alias("keys"), F.size(keys).alias("k")).agg(F.count(F.lit(1)).alias("count"))


def top_categories(df: DataFrame, by: list[str], category: str, k: int) -> DataFrame:
    """The ``k`` most frequent categories per group; all others add up to ``OTHER``.

    The tail is total minus head, so the full category table is never ranked in one task.
    """
    counts = df.groupBy(*by, category).agg(F.count(F.lit(1)).alias("n"))
    head = top_per_group(counts, by, [F.desc("n"), F.col(category)], k).select(*by, category, "n")
    total = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    rest = null_safe_join(total, head.groupBy(*by).agg(F.sum("n").alias("_head")), by)
    other = rest.where("_all > _head").select(*by, F.lit("OTHER").alias(category), (F.col("_all") - F.col("_head")).alias("n"))
    return head.unionByName(other)


