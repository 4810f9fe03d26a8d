"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.runtime import cut_lineage


def _num(x: Column) -> Column:
    return x.cast("double")


def log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two-cell log-likelihood (G2); 0 where a corpus is empty or the term occurs in neither."""
    k1, n1, k2, n2 = map(_num, (k1, n1, k2, n2))
    share = F.try_divide(k1 + k2, n1 + n2)
    e1, e2 = n1 * share, n2 * share

    def term(k, e):
        return F.when((k == 0) | (e == 0), 0.0).otherwise(k * F.ln(k / e))

    return F.when((n1 <= 0) | (n2 <= 0) | (k1 + k2 == 0), 0.0).otherwise(2.0 * (term(k1, e1) + term(k2, e2)))


def log_ratio(k1: Column, n1: Column, k2: Column, n2: Column, *, smoothing: float = 0.5, denominator: float | None = None) -> Column:
    """Binary log of the ratio of smoothed relative frequencies; ``denominator`` is added to the sizes."""
    d = smoothing if denominator is None else denominator
    return F.log2(((_num(k1) + smoothing) / (_num(n1) + d)) / ((_num(k2) + smoothing) / (_num(n2) + d)))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by a Chebyshev fit (relative error below 1.2e-7)."""
    # Coefficients of the fit, constant term first.
    coefficients = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def chi2_tail(x: Column) -> Column:
    """P(chi-square with one degree of freedom > x)."""
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2.0))


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q_value_bh") -> DataFrame:
    """Adds the false-discovery rate of each p-value; rows with a null one get null.

    Rows are range partitioned on the p-value.  The driver sees two numbers per range (its rows and its
    least p m / rank), which give the ranks before and the minima behind each range.
    """
    ranged = cut_lineage(df.repartitionByRange(F.col(p).asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in ranged.filter(F.col(p).isNotNull()).groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row per range
    m, before, offsets = sum(sizes.values()), 0, {}
    for part in sorted(sizes):
        offsets[part], before = before, before + sizes[part]

    def by_part(values: dict[int, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("_part")] if values else F.lit(None)

    within = Window.partitionBy("_part").orderBy(F.col(p).asc_nulls_last())
    rank = by_part(offsets) + F.row_number().over(within)
    scaled = ranged.withColumn("_v", F.when(F.col(p).isNotNull(), F.col(p) * F.lit(float(m)) / rank))
    least = {r["_part"]: r["v"] for r in scaled.groupBy("_part").agg(F.min("_v").alias("v")).collect() if r["v"] is not None}
    behind, low = {}, float("inf")
    for part in sorted(least, reverse=True):
        behind[part], low = low, min(low, least[part])
    later = within.rowsBetween(0, Window.unboundedFollowing)
    value = F.least(F.lit(1.0), F.min("_v").over(later), by_part(behind).cast("double"))
    return scaled.withColumn(out, F.when(F.col(p).isNotNull(), value)).drop("_v", "_part")


def pmi(joint: Column, n: Column, node: Column, collocate: Column) -> Column:
    one = F.lit(1.0)
    return F.log2(_num(joint) * F.greatest(one, _num(n)) / F.greatest(one, _num(node) * _num(collocate)))


def log_dice(joint: Column, node: Column, collocate: Column) -> Column:
    return 14.0 + F.log2(2.0 * _num(joint) / F.greatest(F.lit(1.0), _num(node) + _num(collocate)))


def rate(k: Column, n: Column, per: float) -> Column:
    """k in ``per`` of n; 0 where n is 0 or null."""
    return F.coalesce(F.try_divide(_num(k) * per, _num(n)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column) -> Column:
    """The vector over its length; a null vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin; the greatest value falls into the last one, all into bin 0 where the range is empty."""
    step = (high - low) / bins
    return F.when(step > 0, F.least(F.lit(bins - 1), F.floor((value - low) / step).cast("int"))).otherwise(0)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``ari, n``: agreement of two labelings from their contingency counts; 1 where both are trivial."""

    def pairs(x):
        return F.sum(x.cast("double") * (x - 1) / 2)

    cells = df.groupBy(a, b).agg(F.count("*").alias("c"))
    rows = cells.groupBy(a).agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("sa"))
    cols = cells.groupBy(b).agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("sb"))
    both = cells.agg(pairs(F.col("c")).alias("s"), F.sum("c").alias("n"))
    one = both.withColumn("_k", F.lit(1)).join(rows.withColumn("_k", F.lit(1)), "_k").join(cols.withColumn("_k", F.lit(1)), "_k")  # three one-row tables
    total = F.col("n").cast("double") * (F.col("n") - 1) / 2
    expected = F.col("sa") * F.col("sb") / total
    most = (F.col("sa") + F.col("sb")) / 2
    return one.select(F.coalesce(F.try_divide(F.col("s") - expected, most - expected), F.lit(1.0)).alias("ari"), F.col("n").cast("bigint").alias("n"))


def exact_median(df: DataFrame, value: str, *, bins: int = 4096, small: int = 10_000) -> float | None:
    """The median (mean of the middle two), exactly, without gathering the values.

    Each pass counts the rows in ``bins`` equal bins of the interval that holds the middle and
    goes on with that bin; at most ``small`` distinct values are read in the end.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    first = rows.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, whole = first["n"], (first["lo"], first["hi"])
    if not n:
        return None

    def at_rank(rank: int) -> float:
        (lo, hi), below = whole, 0
        while lo < hi:
            inside = rows.filter((F.col("v") >= lo) & (F.col("v") <= hi))
            found = inside.select("v").distinct().limit(small + 1).count()
            if found <= small:
                for r in inside.groupBy("v").agg(F.count("*").alias("c")).orderBy("v").collect():
                    below += r["c"]
                    if below > rank:
                        return r["v"]
            b = F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / ((hi - lo) / bins)).cast("int"))
            for r in inside.groupBy(b.alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z")).orderBy("b").collect():
                if below + r["c"] > rank:
                    lo, hi = r["a"], r["z"]
                    break
                below += r["c"]
        return lo

    middle = (n - 1) // 2
    a = at_rank(middle)
    return a if n % 2 else (a + at_rank(middle + 1)) / 2
