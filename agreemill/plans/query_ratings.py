"""Registered queries over rated rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.functions.numbers import known, python_round, r6, ratio
from agreemill.operators import stats
from agreemill.operators.ranks import pooled
from agreemill.plans import checks, conditions, keysets, keytable
from agreemill.sources import testdata as td
from agreemill.sources.testdata import sql


def _by_method(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Rated rows under their own method and under ALL."""
    return pooled(td.rated(spark, sf_dir).select("method", *cols), "method")


def _h() -> Column:
    return (F.col("g1") + F.col("g2")) / 2


def rating_alpha_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.rated(spark, sf_dir).agg(F.count("*").alias("n"), r6(stats.alpha("g1", "g2")).alias("alpha"))


def rating_alpha_per_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_method(spark, sf_dir, "g1", "g2", "judge")
    grid = rows.groupBy("method").agg(F.count("*").alias("n"), r6(stats.alpha("judge", "g1")).alias("alpha"))
    own = F.col("method") != "ALL"
    count = grid.agg(F.count_if(own & (F.col("alpha") > 0)).alias("n_positive"), F.count(F.when(own, F.col("alpha"))).alias("n_methods"))
    return grid.crossJoin(F.broadcast(count))


def rating_kd_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_method(spark, sf_dir, "x", "g1", "g2")
    return rows.groupBy("method").agg(r6(stats.kd("x", "g1", "g2", False)).alias("kd"))


def rating_kd_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_method(spark, sf_dir, "judge", "g1", "g2")
    return rows.groupBy("method").agg(r6(stats.kd("judge", "g1", "g2", True)).alias("kd"))


def rating_kd_paper_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each alpha to three decimals, then their mean, as Python rounds."""
    rows = _by_method(spark, sf_dir, "judge", "g1", "g2")
    two = rows.groupBy("method").agg(stats.alpha("judge", "g1").alias("a1"), stats.alpha("judge", "g2").alias("a2"))
    part = two.select("method", python_round(F.col("a1"), 3).alias("a1"), python_round(F.col("a2"), 3).alias("a2"))
    return part.select("method", "a1", "a2", python_round((F.col("a1") + F.col("a2")) / 2, 3).alias("kd"))


def rating_kd_pooled_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-method Kd with the range of the scores over all methods."""
    rows = td.rated(spark, sf_dir).select("method", "x", "g1", "g2")
    span = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    at = rows.crossJoin(F.broadcast(span))
    one = lambda g: stats.alpha_scaled("x", g, F.min("low"), F.max("high"))
    return at.groupBy("method").agg(r6((one("g1") + one("g2")) / 2).alias("kd"))


def rating_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_method(spark, sf_dir, "judge", "g1", "g2").withColumn("h", _h())
    return stats.spearman(rows, "judge", "h", ["method"]).select("method", "n", r6(F.col("rho")).alias("rho"))


def rating_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_method(spark, sf_dir, "x", "judge", "g1", "g2")
    return rows.groupBy("method").agg(r6(stats.pearson("judge", _h())).alias("r_judge"), r6(stats.pearson("x", _h())).alias("r_x"), stats.pearson(F.lit(1.0), _h()).alias("r_constant"))


def rating_endpoint_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge's AUC on mean ratings from 3.5 up against 0.5 down."""
    rows = _by_method(spark, sf_dir, "judge", "g1", "g2").withColumn("h", _h()).where((F.col("h") >= 3.5) | (F.col("h") <= 0.5))
    out = stats.auc(rows, "judge", F.col("h") >= 3.5, ["method"])
    enough = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    return out.select("method", "n_pos", "n_neg", F.when(enough, r6(F.col("auc"))).alias("auc"))


def rating_cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, r, rho, mean and deviation by method and subject; NULL under three rows."""
    rows = td.rated(spark, sf_dir).withColumn("h", _h()).select("method", "subject", "judge", "h")
    by = ["method", "subject"]
    ranked = stats.ranked_pair(rows, "judge", "h", by)
    ok = F.count("*") >= 3
    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.when(ok, r6(stats.pearson("judge", "h"))).alias("r"), F.when(ok, r6(stats.pearson("rank_x", "rank_y"))).alias("rho"), F.when(ok, r6(F.avg("judge"))).alias("mean"), F.when(ok, r6(F.stddev_pop("judge"))).alias("sd")
    )


def rating_human_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = stats.ranked_pair(_by_method(spark, sf_dir, "g1", "g2"), "g1", "g2", ["method"])
    return ranked.groupBy("method").agg(F.count("*").alias("n"), r6(stats.alpha("g1", "g2")).alias("alpha"), r6(stats.pearson("rank_x", "rank_y")).alias("rho"))


def rating_runs_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation of Kd over three runs of a judge."""
    rows = td.rated(spark, sf_dir).select("method", "g1", "g2", F.posexplode(F.array(*[F.least(F.greatest(F.col("judge") + (F.col("key") % (r + 2)) - r % 2, F.lit(0.0)), F.lit(4.0)) for r in range(3)])).alias("run", "judge"))
    runs = rows.groupBy("method", "run").agg(stats.kd("judge", "g1", "g2", True).alias("kd"))
    return runs.groupBy("method").agg(F.count("*").alias("n_runs"), r6(F.avg("kd")).alias("mean"), r6(F.stddev_pop("kd")).alias("sd"))


def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in 30 bins by rounded mean rating (half to even)."""
    rows = td.rated(spark, sf_dir).select(F.bround(_h(), 0).cast("int").alias("bucket"), "x")
    span = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.least(F.floor(ratio(F.col("x") - F.col("low"), F.col("high") - F.col("low")) * 30), F.lit(29)).cast("int")
    return rows.crossJoin(F.broadcast(span)).groupBy("bucket", place.alias("bin")).agg(F.count("*").alias("n"))


def binary_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = td.table(spark, sf_dir, "labels").select(F.col("quality").alias("x"), (1 - F.col("toxic")).alias("y"))
    return rows.agg(F.count("*").alias("n"), r6(stats.alpha("x", "y")).alias("alpha"))


RATERS = ["g1", "g2", "a", "b", "c"]


def keytable_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = td.rated(spark, sf_dir)
    wide = keytable.build(rows.select("method", "key", F.concat("method", F.lit("-"), "key").alias("name")), td.long_scores(rows), RATERS)
    parts = [F.count(c).alias(f"n_{c}") for c in RATERS]
    return wide.groupBy("method").agg(F.count("*").alias("n"), *parts, *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in RATERS], F.min("name").alias("first_name"))


def keyset_full_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = td.rated(spark, sf_dir)
    scores = td.long_scores(rows).where((F.col("rater") != "c") | (F.col("method") != "1-URGENT"))
    full = keysets.covering(scores, 5)
    keys = keysets.common_keys(scores, full)
    return keysets.restricted(rows, keys).groupBy("method").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.sum("key").alias("sum_key"))


def keyset_nway(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = td.rated(spark, sf_dir)
    scores = td.long_scores(rows).where((F.col("rater") != "c") | (F.col("method") != "1-URGENT")).withColumn("value", F.when((F.col("rater") == "b") & (F.col("key") % 13 == 0), F.lit(float("nan"))).otherwise(F.col("value")))
    keys = keysets.present_keys(scores)
    return keysets.restricted(rows, keys).groupBy("method").agg(F.count("*").alias("n"), F.sum("key").alias("sum_key"), r6(stats.alpha("judge", "g1")).alias("alpha"))


def filter_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conditions.at_thresholds(td.rated(spark, sf_dir))
    return rows.groupBy("t").agg(F.count("*").alias("n"), r6(stats.kd("x", "g1", "g2", False)).alias("kd_x"), r6(stats.kd("judge", "g1", "g2", True)).alias("kd_judge"))


def filter_valid_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = td.rated(spark, sf_dir).withColumn("n_ref_fg_patches", F.floor(F.col("fg_ref") * 10).cast("int"))
    return conditions.valid_reference(rows).groupBy("method").agg(F.count("*").alias("n"), r6(stats.kd("judge", "g1", "g2", True)).alias("kd"))


def _conditioned(rows: DataFrame) -> DataFrame:
    return rows.groupBy("method").agg(F.count("*").alias("n"), r6(F.min("x")).alias("min_x"), r6(F.avg("x")).alias("mean_x"), r6(F.avg("judge")).alias("mean_judge"), r6(stats.kd("judge", "g1", "g2", True)).alias("kd"))


def filter_scale_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conditioned(conditions.scale_minimum(td.rated(spark, sf_dir), ["x"], ["judge"]))


def filter_raw_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conditioned(conditions.raw_zero(td.rated(spark, sf_dir), ["x", "judge"]))


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a 5 % mask filter drops, and how the dropped rows were rated."""
    rows = td.rated(spark, sf_dir).withColumn("h", _h()).withColumn("fate", conditions.fate(0.05))
    return rows.groupBy("fate").agg(F.count("*").alias("n"), r6(F.avg("h")).alias("mean_h"), r6(F.avg("fg_ref")).alias("mean_fg_ref"), r6(F.max("fg_out")).alias("max_fg_out"))


def ablation_grid_2x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement by pool and prompt over the full 3 x 2 grid; cells not run are empty."""
    rows = td.cells(spark, sf_dir)
    ranked = stats.ranked_pair(rows, "score", "rating", ["pool", "prompt"])
    cells = ranked.groupBy("pool", "prompt").agg(F.count("*").alias("n"), stats.alpha_scaled("score", F.col("rating") * 0.08).alias("alpha"), stats.pearson("rank_x", "rank_y").alias("rho"))
    grid = spark.sql("SELECT pool, prompt FROM VALUES ('A'), ('N'), ('R') AS p(pool), LATERAL (VALUES ('F'), ('O')) AS q(prompt)")
    full = grid.join(F.broadcast(cells), ["pool", "prompt"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    at = lambda p, q: F.max(F.when((F.col("pool") == p) & (F.col("prompt") == q), F.col("rho")))
    contrast = full.agg(((at("N", "O") - at("N", "F")) - (at("R", "O") - at("R", "F"))).alias("contrast"))
    return full.crossJoin(F.broadcast(contrast)).select("pool", "prompt", "n", r6(F.col("alpha")).alias("alpha"), r6(F.col("rho")).alias("rho"), r6(F.col("contrast")).alias("contrast"))


def source_robustness_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of each source on the keys all have, and its change against a."""
    rows = td.rated(spark, sf_dir)
    scores = td.long_scores(rows)
    wide = keytable.wide(keysets.restricted(scores, keysets.present_keys(scores)), RATERS)
    long = wide.select("g1", "g2", F.inline(F.array(*[F.struct(F.lit(r).alias("source"), F.col(r).alias("value")) for r in ("a", "b", "c")])))
    kd = long.groupBy("source").agg(F.count("*").alias("n"), stats.kd("value", "g1", "g2", False).alias("kd"))
    base = kd.where("source = 'a'").select(F.col("kd").alias("base"))
    return kd.crossJoin(F.broadcast(base)).select("source", "n", r6(F.col("kd")).alias("kd"), r6(F.col("kd") - F.col("base")).alias("delta"))


def check_printed_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's price in thousands against a printed number of none to three
    digits: a digit off for some, halves exactly between two digits for others,
    within a tolerance for every third."""
    k, digits = F.col("key"), (F.col("key") % 4).cast("int")
    half = F.floor("x") / 8
    ours = F.when(k % 5 == 0, half).otherwise(F.col("x") / 1000)
    unit = F.pow(F.lit(10.0), -digits)
    cells = td.rated(spark, sf_dir).select("method", ours.alias("ours"), (ours + F.when(k % 7 == 0, unit).otherwise(0.0)).alias("paper"), digits.alias("digits"), F.when(k % 3 == 0, unit * 1.5).alias("tol"))
    return checks.checked(cells).groupBy("method", "digits").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if("same_print").alias("n_same_print"))


def matched_error_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total absolute error of per-method agreement against reference values."""
    kd = td.rated(spark, sf_dir).groupBy("method").agg(stats.kd("judge", "g1", "g2", True).alias("kd"))
    return kd.agg(F.count("*").alias("n"), r6(F.sum(F.abs(F.col("kd") - 0.8))).alias("total_error"))


def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner merge of three metrics on the key, with missing scores."""
    rows = td.rated(spark, sf_dir)
    frames = {"a": rows.where("key % 5 <> 0").select("method", "key", F.col("x").alias("score")), "b": rows.where("key % 7 <> 0").select("method", "key", F.col("judge").alias("score")), "c": rows.select("method", "key", known(F.col("x") / 2).alias("score"))}
    out = keytable.merged(frames, ["method", "key"])
    return out.groupBy("method").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in "abc"])


QUERIES = {
    f.__name__: f
    for f in (
        rating_alpha_pooled, rating_alpha_per_method, rating_kd_continuous, rating_kd_ordinal, rating_kd_paper_rounded, rating_kd_pooled_range, rating_spearman, rating_pearson, rating_endpoint_auc, rating_cell_stats,
        rating_human_ceiling, rating_runs_mean_std, rating_histogram, binary_alpha, keytable_build, keyset_full_coverage, keyset_nway, filter_threshold_sweep, filter_valid_reference, filter_scale_minimum, filter_raw_zero,
        filter_audit, ablation_grid_2x3, source_robustness_delta, check_printed_precision, matched_error_total, merged_metrics,
    )
}


def _alpha(x: str, y: str) -> str:
    """Interval alpha straight from its definition."""
    de = f"(2 * 2 * count(*) * ((sum(({x}) * ({x})) + sum(({y}) * ({y}))) / (2 * count(*)) - pow((sum({x}) + sum({y})) / (2 * count(*)), 2)) / (2 * count(*) - 1))"
    return f"(CASE WHEN {de} > 1e-12 THEN 1 - avg(pow(({x}) - ({y}), 2)) / {de} END)"


def _kd(x: str, g1: str = "g1", g2: str = "g2") -> str:
    return f"(({_alpha(x, g1)} + {_alpha(x, g2)}) / 2)"


_BOTH = "b AS (SELECT * FROM v_rated UNION ALL SELECT * REPLACE ('ALL' AS method) FROM v_rated)"
_NORM = "CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END"
_RANK = "(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2::DOUBLE)"


def _rank(v: str, by: str) -> str:
    return _RANK.format(v=v, by=by)


_RAW = "* REPLACE ({x} AS x, CASE WHEN fg_ref > 0 AND fg_out > 0 THEN judge ELSE 0 END AS judge)"
_COND = f"SELECT method, count(*) AS n, round(min(x), 6) AS min_x, round(avg(x), 6) AS mean_x, round(avg(judge), 6) AS mean_judge, round({_kd('judge')}, 6) AS kd FROM c GROUP BY method"

ORACLE_SQL = {
    "rating_alpha_pooled": sql(f"SELECT count(*) AS n, round({_alpha('g1', 'g2')}, 6) AS alpha FROM v_rated", "v_rated"),
    "rating_alpha_per_method": sql(
        f"""WITH {_BOTH}, g AS (SELECT method, count(*) AS n, round({_alpha("judge", "g1")}, 6) AS alpha FROM b GROUP BY method)
        SELECT *, (SELECT count(*) FROM g WHERE method <> 'ALL' AND alpha > 0) AS n_positive, (SELECT count(alpha) FROM g WHERE method <> 'ALL') AS n_methods FROM g""",
        "v_rated",
    ),
    "rating_kd_continuous": sql(f"WITH {_BOTH}, s AS (SELECT method, {_NORM} AS xn, g1 / 4 AS g1, g2 / 4 AS g2 FROM b WINDOW w AS (PARTITION BY method)) SELECT method, round({_kd('xn')}, 6) AS kd FROM s GROUP BY method", "v_rated"),
    "rating_kd_ordinal": sql(f"WITH {_BOTH} SELECT method, round({_kd('judge')}, 6) AS kd FROM b GROUP BY method", "v_rated"),
    "rating_kd_paper_rounded": sql(
        f"""WITH {_BOTH}, s AS (SELECT method, CAST(format('{{:.3f}}', {_alpha("judge", "g1")}) AS DOUBLE) AS a1, CAST(format('{{:.3f}}', {_alpha("judge", "g2")}) AS DOUBLE) AS a2 FROM b GROUP BY method)
        SELECT method, a1, a2, CAST(format('{{:.3f}}', (a1 + a2) / 2) AS DOUBLE) AS kd FROM s""",
        "v_rated",
    ),
    "rating_kd_pooled_range": sql(f"WITH s AS (SELECT method, {_NORM} AS xn, g1 / 4 AS g1, g2 / 4 AS g2 FROM v_rated WINDOW w AS ()) SELECT method, round({_kd('xn')}, 6) AS kd FROM s GROUP BY method", "v_rated"),
    "rating_spearman": sql(f"WITH {_BOTH}, h AS (SELECT method, judge, (g1 + g2) / 2 AS h FROM b), r AS (SELECT method, {_rank('judge', 'method')} AS a, {_rank('h', 'method')} AS c FROM h) SELECT method, count(*) AS n, round(corr(a, c), 6) AS rho FROM r GROUP BY method", "v_rated"),
    "rating_pearson": sql(f"WITH {_BOTH} SELECT method, round(corr(judge, (g1 + g2) / 2), 6) AS r_judge, round(corr(x, (g1 + g2) / 2), 6) AS r_x, CAST(NULL AS DOUBLE) AS r_constant FROM b GROUP BY method", "v_rated"),
    "rating_endpoint_auc": sql(
        f"""WITH {_BOTH}, h AS (SELECT method, judge, (g1 + g2) / 2 >= 3.5::DOUBLE AS pos FROM b WHERE (g1 + g2) / 2 >= 3.5::DOUBLE OR (g1 + g2) / 2 <= 0.5::DOUBLE),
        r AS (SELECT method, pos, {_rank("judge", "method")} AS k FROM h), c AS (SELECT method, count(*) FILTER (WHERE pos) AS n_pos, count(*) FILTER (WHERE NOT pos) AS n_neg, sum(k) FILTER (WHERE pos) AS s FROM r GROUP BY method)
        SELECT method, n_pos, n_neg, CASE WHEN n_pos >= 2 AND n_neg >= 2 THEN round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) END AS auc FROM c""",
        "v_rated",
    ),
    "rating_cell_stats": sql(
        f"""WITH h AS (SELECT method, subject, judge, (g1 + g2) / 2 AS h FROM v_rated), r AS (SELECT *, {_rank("judge", "method, subject")} AS a, {_rank("h", "method, subject")} AS c FROM h)
        SELECT method, subject, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(judge) * var_pop(h) > 0 THEN round(corr(judge, h), 6) END AS r, CASE WHEN count(*) >= 3 AND var_pop(a) * var_pop(c) > 0 THEN round(corr(a, c), 6) END AS rho,
        CASE WHEN count(*) >= 3 THEN round(avg(judge), 6) END AS mean, CASE WHEN count(*) >= 3 THEN round(stddev_pop(judge), 6) END AS sd FROM r GROUP BY method, subject""",
        "v_rated",
    ),
    "rating_human_ceiling": sql(f"WITH {_BOTH}, r AS (SELECT method, g1, g2, {_rank('g1', 'method')} AS a, {_rank('g2', 'method')} AS c FROM b) SELECT method, count(*) AS n, round({_alpha('g1', 'g2')}, 6) AS alpha, round(corr(a, c), 6) AS rho FROM r GROUP BY method", "v_rated"),
    "rating_runs_mean_std": sql(
        f"""WITH j AS (SELECT method, g1, g2, run, CAST(least(greatest(judge + key % (run + 2) - run % 2, 0), 4) AS DOUBLE) AS judge FROM v_rated, range(0, 3) AS t(run)),
        k AS (SELECT method, run, {_kd("judge")} AS kd FROM j GROUP BY method, run) SELECT method, count(*) AS n_runs, round(avg(kd), 6) AS mean, round(stddev_pop(kd), 6) AS sd FROM k GROUP BY method""",
        "v_rated",
    ),
    "rating_histogram": sql(
        """WITH s AS (SELECT CAST(round_even((g1 + g2) / 2, 0) AS INTEGER) AS bucket, x, min(x) OVER () AS low, max(x) OVER () AS high FROM v_rated)
        SELECT bucket, CAST(least(floor((x - low) / (high - low) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY ALL""",
        "v_rated",
    ),
    "binary_alpha": f"WITH b AS (SELECT CAST(quality AS DOUBLE) AS x, CAST(1 - toxic AS DOUBLE) AS y FROM labels) SELECT count(*) AS n, round({_alpha('x', 'y')}, 6) AS alpha FROM b",
    "keytable_build": sql(
        "WITH p AS (SELECT method, key, "
        + ", ".join(f"max(value) FILTER (WHERE rater = '{r}') AS {r}" for r in RATERS)
        + " FROM v_long GROUP BY method, key) SELECT r.method, count(*) AS n, "
        + ", ".join(f"count(p.{r}) AS n_{r}, round(avg(p.{r}), 4) AS mean_{r}" for r in RATERS)
        + ", min(r.method || '-' || r.key) AS first_name FROM v_rated r LEFT JOIN p ON r.method = p.method AND r.key = p.key GROUP BY r.method",
        "v_rated",
        "v_long",
    ),
    "keyset_full_coverage": sql(
        """WITH s AS (SELECT * FROM v_long WHERE rater <> 'c' OR method <> '1-URGENT'), f AS (SELECT rater FROM s GROUP BY rater HAVING count(DISTINCT method) = 5),
        k AS (SELECT method, key FROM s WHERE rater IN (SELECT rater FROM f) GROUP BY method, key HAVING count(DISTINCT rater) = (SELECT count(*) FROM f))
        SELECT method, count(*) AS n, min(key) AS first_key, CAST(sum(key) AS BIGINT) AS sum_key FROM v_rated SEMI JOIN k USING (method, key) GROUP BY method""",
        "v_rated",
        "v_long",
    ),
    "keyset_nway": sql(
        f"""WITH s AS (SELECT * FROM v_long WHERE rater <> 'c' OR method <> '1-URGENT'), n AS (SELECT method, count(DISTINCT rater) AS n FROM s GROUP BY method),
        k AS (SELECT s.method, key FROM s JOIN n ON s.method = n.method WHERE NOT (rater = 'b' AND key % 13 = 0) GROUP BY s.method, key, n.n HAVING count(DISTINCT rater) = n.n)
        SELECT method, count(*) AS n, CAST(sum(key) AS BIGINT) AS sum_key, round({_alpha("judge", "g1")}, 6) AS alpha FROM v_rated SEMI JOIN k USING (method, key) GROUP BY method""",
        "v_rated",
        "v_long",
    ),
    "filter_threshold_sweep": sql(
        f"""WITH s AS (SELECT t, r.* FROM v_rated r, (VALUES (0::DOUBLE), (0.025::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) AS v(t) WHERE fg_ref > t AND fg_out > t),
        u AS (SELECT t, judge, g1, g2, (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) AS xn, g1 / 4 AS h1, g2 / 4 AS h2 FROM s WINDOW w AS (PARTITION BY t))
        SELECT t, count(*) AS n, round({_kd("xn", "h1", "h2")}, 6) AS kd_x, round({_kd("judge")}, 6) AS kd_judge FROM u GROUP BY t""",
        "v_rated",
    ),
    "filter_valid_reference": sql(f"SELECT method, count(*) AS n, round({_kd('judge')}, 6) AS kd FROM v_rated WHERE CAST(floor(fg_ref * 10) AS INTEGER) > 0 GROUP BY method", "v_rated"),
    "filter_scale_minimum": sql(f"WITH c AS (SELECT {_RAW.format(x='CASE WHEN fg_ref > 0 AND fg_out > 0 THEN x ELSE (SELECT min(x) FROM v_rated WHERE fg_ref > 0 AND fg_out > 0) END')} FROM v_rated) {_COND}", "v_rated"),
    "filter_raw_zero": sql(f"WITH c AS (SELECT {_RAW.format(x='CASE WHEN fg_ref > 0 AND fg_out > 0 THEN x ELSE 0 END')} FROM v_rated) {_COND}", "v_rated"),
    "filter_audit": sql(
        """SELECT CASE WHEN NOT fg_ref > 0.05::DOUBLE THEN 'ref' WHEN NOT fg_out > 0.05::DOUBLE THEN 'out' ELSE 'kept' END AS fate, count(*) AS n, round(avg((g1 + g2) / 2), 6) AS mean_h,
        round(avg(fg_ref), 6) AS mean_fg_ref, round(max(fg_out), 6) AS max_fg_out FROM v_rated GROUP BY ALL""",
        "v_rated",
    ),
    "ablation_grid_2x3": sql(
        f"""WITH r AS (SELECT pool, prompt, {_rank("score", "pool, prompt")} AS a, {_rank("rating", "pool, prompt")} AS c, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS xn, rating * 0.08::DOUBLE / 4 AS g FROM v_cells WINDOW w AS (PARTITION BY pool, prompt)),
        c AS (SELECT pool, prompt, count(*) AS n, {_alpha("xn", "g")} AS alpha, corr(a, c) AS rho FROM r GROUP BY pool, prompt), g AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) AS p(pool), (VALUES ('F'), ('O')) AS q(prompt)),
        f AS (SELECT g.pool, g.prompt, coalesce(n, 0) AS n, alpha, rho FROM g LEFT JOIN c ON g.pool = c.pool AND g.prompt = c.prompt),
        x AS (SELECT (max(rho) FILTER (WHERE pool = 'N' AND prompt = 'O') - max(rho) FILTER (WHERE pool = 'N' AND prompt = 'F')) - (max(rho) FILTER (WHERE pool = 'R' AND prompt = 'O') - max(rho) FILTER (WHERE pool = 'R' AND prompt = 'F')) AS contrast FROM f)
        SELECT pool, prompt, n, round(alpha, 6) AS alpha, round(rho, 6) AS rho, round(contrast, 6) AS contrast FROM f, x""",
        "v_cells",
    ),
    "source_robustness_delta": sql(
        f"""WITH n AS (SELECT method, count(DISTINCT rater) AS n FROM v_long GROUP BY method), k AS (SELECT s.method, key FROM v_long s JOIN n ON s.method = n.method GROUP BY s.method, key, n.n HAVING count(DISTINCT rater) = n.n),
        l AS (SELECT s.rater AS source, s.value AS x, r.g1 / 4 AS g1, r.g2 / 4 AS g2 FROM v_long s SEMI JOIN k USING (method, key) JOIN v_rated r USING (method, key) WHERE s.rater IN ('a', 'b', 'c')),
        m AS (SELECT source, {_NORM} AS xn, g1, g2 FROM l WINDOW w AS (PARTITION BY source)), d AS (SELECT source, count(*) AS n, {_kd("xn")} AS kd FROM m GROUP BY source)
        SELECT source, n, round(kd, 6) AS kd, round(kd - (SELECT kd FROM d WHERE source = 'a'), 6) AS delta FROM d""",
        "v_rated",
        "v_long",
    ),
    "check_printed_precision": sql(
        """WITH r AS (SELECT method, key % 4 AS digits, CASE WHEN key % 5 = 0 THEN floor(x) / 8 ELSE x / 1000 END AS ours, key FROM v_rated),
        c AS (SELECT *, pow(10.0::DOUBLE, -digits) AS unit FROM r), p AS (SELECT *, ours + CASE WHEN key % 7 = 0 THEN unit ELSE 0.0::DOUBLE END AS paper, CASE WHEN key % 3 = 0 THEN unit * 1.5::DOUBLE END AS tol FROM c),
        s AS (SELECT *, CASE digits WHEN 0 THEN format('{:.0f}', ours) = format('{:.0f}', paper) WHEN 1 THEN format('{:.1f}', ours) = format('{:.1f}', paper) WHEN 2 THEN format('{:.2f}', ours) = format('{:.2f}', paper) ELSE format('{:.3f}', ours) = format('{:.3f}', paper) END AS same FROM p)
        SELECT method, CAST(digits AS INTEGER) AS digits, count(*) AS n, count(*) FILTER (WHERE CASE WHEN tol IS NULL THEN same ELSE abs(ours - paper) <= tol + pow(10.0::DOUBLE, -(digits + 3)) END) AS n_ok, count(*) FILTER (WHERE same) AS n_same_print FROM s GROUP BY ALL""",
        "v_rated",
    ),
    "matched_error_total": sql(f"WITH k AS (SELECT method, {_kd('judge')} AS kd FROM v_rated GROUP BY method) SELECT count(*) AS n, round(sum(abs(kd - 0.8::DOUBLE)), 6) AS total_error FROM k", "v_rated"),
    "merged_metrics": sql("SELECT method, count(*) AS n, round(avg(x), 4) AS mean_a, round(avg(judge), 4) AS mean_b, round(avg(x / 2), 4) AS mean_c FROM v_rated WHERE key % 5 <> 0 AND key % 7 <> 0 GROUP BY method", "v_rated"),
}
