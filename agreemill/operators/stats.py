"""Agreement statistics as single-pass aggregates.

Everything that depends on moments only is one aggregate expression, so Spark
combines it on the map side: no rows are exploded, sorted or collected. Ranks
(Spearman, AUC) come from counts by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agreemill.functions.numbers import c, ratio
from agreemill.operators.ranks import bucketed_totals, with_ranks


def _alpha(n: Column, mx: Column, my: Column, vx: Column, vy: Column, cxy: Column) -> Column:
    """Interval Krippendorff's alpha of two raters from population moments.

    Observed disagreement is the mean squared difference; expected is
    2M/(M-1) times the variance of both raters' values together, M = 2n.
    """
    observed = vx + vy - 2 * cxy + (mx - my) * (mx - my)
    spread = (vx + vy) / 2 + (mx - my) * (mx - my) / 4
    m = 2 * n
    expected = ratio(2 * m * spread, m - 1)
    return F.when(expected > 0, 1 - ratio(observed, expected))


def variance(x: Column) -> Column:
    """Aggregate: population variance, 0 for one value. Partial variances of one
    value merge to some 1e-33, since n times 1 / n need not be 1."""
    return F.when((F.min(x) == F.max(x)) & ~F.isnan(F.max(x)), 0.0).otherwise(F.var_pop(x))


def alpha(x: Column | str, y: Column | str) -> Column:
    """Aggregate: interval alpha of x and y; NULL without spread."""
    x, y = c(x).cast("double"), c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return _alpha(F.count(x), F.avg(x), F.avg(y), variance(x), variance(y), F.covar_pop(x, y))


def alpha_scaled(x: Column | str, g: Column | str, low: Column | None = None, high: Column | None = None, top: float = 4.0) -> Column:
    """Aggregate: alpha of min-max normalised x and g / top.

    The range is that of the aggregated rows unless ``low`` and ``high``
    (aggregates too) are given. An empty range gives NULL.
    """
    x, g = c(x).cast("double"), c(g).cast("double") / top
    low = F.min(x) if low is None else low
    span = (F.max(x) if high is None else high) - low
    return _alpha(F.count(x), ratio(F.avg(x) - low, span), F.avg(g), ratio(variance(x), span * span), variance(g), ratio(F.covar_pop(x, g), span))


def kd(x: Column | str, g1: Column | str, g2: Column | str, ordinal: bool) -> Column:
    """Aggregate: mean alpha against two human groups."""
    one = (lambda g: alpha(x, g)) if ordinal else (lambda g: alpha_scaled(x, g))
    return (one(g1) + one(g2)) / 2


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate: correlation of the rows that have both; NULL without variance."""
    x, y = c(x).cast("double"), c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = variance(x) * variance(y)
    return F.when(spread > 0, ratio(F.covar_pop(x, y), F.sqrt(spread)))


def ranked_pair(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Average ranks of x and y as ``rank_x`` and ``rank_y``."""
    return with_ranks(df, {x: "rank_x", y: "rank_y"}, by)


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, name: str = "rho") -> DataFrame:
    """(by, n, rho): correlation of average ranks."""
    ranked = ranked_pair(df.select(*(by or []), x, y), x, y, by)
    return ranked.groupBy(*(by or [])).agg(F.count("*").alias("n"), pearson("rank_x", "rank_y").alias(name))


def score_counts(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(by, score, pos, neg): rows of either kind at each distinct score."""
    return df.groupBy(*(by or []), score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def auc_of_counts(counts: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc) of ``score_counts``, in one pass: wins inside each
    bucket of scores, then wins against the buckets before it. Dealing by range
    samples the counts first, so checkpoint them where they cost more than a scan."""
    by = by or []
    local = bucketed_totals(counts, score, ["neg"], by)
    inner = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2.0))
    parts = local.groupBy(*by, "_bucket").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"), inner.alias("_inner"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_neg").over(before), F.lit(0)))
    wins = F.sum(F.col("_inner") + F.col("_pos").cast("double") * F.col("_before"))
    out = parts.groupBy(*by).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), wins.alias("_wins"))
    return out.select(*by, "n_pos", "n_neg", ratio(F.col("_wins"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"))


def auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc): the chance that a positive row scores higher,
    ties counted half. NULL where a side is empty. Rows are counted by score
    first; only distinct scores are ordered."""
    return auc_of_counts(score_counts(df, score, positive, by), score, by)


def separation(score: Column | str, within: Column, divisor: float = 1.0) -> dict[str, Column]:
    """Aggregates that describe within and cross scores: means, population
    deviations, their difference, and that over the observed range. Scores are
    divided by ``divisor`` first (a metric's own scale)."""
    s = c(score) / divisor
    w, x = F.when(within, s), F.when(~within, s)
    delta = F.avg(w) - F.avg(x)
    span = F.max(s) - F.min(s)
    return {
        "n_within": F.count(w),
        "n_cross": F.count(x),
        "mean_within": F.avg(w),
        "sd_within": F.stddev_pop(w),
        "mean_cross": F.avg(x),
        "sd_cross": F.stddev_pop(x),
        "delta": delta,
        "delta_norm": ratio(delta, F.greatest(span, F.lit(1e-12))),
    }


def separation_of_counts(counts: DataFrame, score: str) -> DataFrame:
    """The columns of ``separation`` from (score, pos, neg), pos being within. The
    deviations are taken about the means, so ``counts`` is read twice."""
    s = F.col(score)
    total = lambda n, v: F.sum(F.when(F.col(n) > 0, F.col(n).cast("double") * v))
    sizes = [F.sum("pos").alias("n_within"), F.sum("neg").alias("n_cross")]
    means = counts.agg(*sizes, total("pos", s).alias("_w"), total("neg", s).alias("_x"), (F.max(s) - F.min(s)).alias("_span"))
    means = means.select("n_within", "n_cross", ratio(F.col("_w"), F.col("n_within")).alias("mean_within"), ratio(F.col("_x"), F.col("n_cross")).alias("mean_cross"), "_span")
    about = counts.crossJoin(F.broadcast(means.select("mean_within", "mean_cross")))
    squares = about.agg(*[total(n, (s - F.col(m)) * (s - F.col(m))).alias(o) for n, m, o in (("pos", "mean_within", "_qw"), ("neg", "mean_cross", "_qx"))])
    delta = F.col("mean_within") - F.col("mean_cross")
    sd = lambda q, n: F.sqrt(ratio(F.col(q), F.col(n)))
    out = means.crossJoin(F.broadcast(squares))
    return out.select(F.coalesce("n_within", F.lit(0)).alias("n_within"), F.coalesce("n_cross", F.lit(0)).alias("n_cross"), "mean_within", sd("_qw", "n_within").alias("sd_within"), "mean_cross", sd("_qx", "n_cross").alias("sd_cross"), delta.alias("delta"), ratio(delta, F.greatest("_span", F.lit(1e-12))).alias("delta_norm"))
