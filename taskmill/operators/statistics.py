"""Uncertainty of means, reports with subtotals, summaries that can be merged. Definitions of our own."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The Poisson distribution of mean 1 in 65,536 parts: how many of them have at most 0, 1, ... events.
POISSON = (24109, 48219, 60274, 64292, 65296, 65497, 65531, 65536)


def poisson_weights(task: Column, replicates: int, seed: str = "0") -> Column:
    """How often each replicate draws a task, by a hash of seed, task and replicate: 16 bits of an md5
    for each, so that a task has the same weights wherever it stands."""
    out = []
    for block in range(-(-replicates // 8)):
        digest = F.md5(F.concat(F.lit(f"{seed}:{block}:"), F.coalesce(task.cast("string"), F.lit(""))))
        out += [F.conv(F.substring(digest, 4 * j + 1, 4), 16, 10).cast("int") for j in range(min(8, replicates - 8 * block))]
    return F.transform(F.array(*out), lambda u: sum((u >= p).cast("int") for p in POISSON))


def bootstrap(results: DataFrame, by: str = "method", task: str = "task", score: str = "score", baseline=None, replicates: int = 64, level: float = 0.95, seed: str = "0") -> DataFrame:
    """by, n, mean, low, high, and with a baseline diff, diff_low, diff_high: means of scores with
    percentile intervals of a Poisson bootstrap.

    Each replicate weighs each task by poisson_weights(); the same for all methods, so that their
    differences to the baseline are paired by task. Rows meet their weights in the one pass
    that reads them, and are summed by method and replicate before the shuffle. Null scores are
    left out; a replicate that draws no row of a method counts for none.
    """
    rows = results.filter(F.col(score).isNotNull()).select(F.col(by).alias("m"), F.col(score).cast("double").alias("s"), F.posexplode(F.concat(F.array(F.lit(1)), poisson_weights(F.col(task), replicates, seed))).alias("b", "w"))
    sums = rows.filter("w > 0").groupBy("m", "b").agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum("w").alias("w"))
    means = sums.select("m", "b", "w", (F.col("s") / F.col("w")).alias("mean"))  # a row for each method and replicate
    ends = [(1 - level) / 2, (1 + level) / 2]
    names = ["mean"]
    if baseline is not None:
        base = means.filter(F.col("m") == baseline).select("b", F.col("mean").alias("base"))
        means = means.join(base, "b", "left").withColumn("diff", F.col("mean") - F.col("base"))
        names.append("diff")
    found = []
    for c in names:
        q = F.percentile(F.when(F.col("b") > 0, F.col(c)), F.array(*map(F.lit, ends)))
        low, high = ("low", "high") if c == "mean" else (f"{c}_low", f"{c}_high")
        found += [F.max(F.when(F.col("b") == 0, F.col(c))).alias(c), q[0].alias(low), q[1].alias(high)]
    return means.groupBy(F.col("m").alias(by)).agg(F.max(F.when(F.col("b") == 0, F.col("w"))).alias("n"), *found)


def report(results: DataFrame, dimensions: tuple[str, ...], scores: tuple[str, ...] = ()) -> DataFrame:
    """dimensions, level, n, and a mean of each score, for every subset of the dimensions.

    level is the grouping id: the dimensions, from the first one (the highest bit), that a row is
    a total over. So a null in a dimension that level doesn't name is a group of null keys. Rows
    are expanded once, and summed before the one shuffle.
    """
    sets = [[results[c] for c in some] for k in range(len(dimensions), -1, -1) for some in combinations(dimensions, k)]
    grouped = results.groupingSets(sets, *[results[c] for c in dimensions])
    return grouped.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(f"avg_{s}") for s in scores])


#: log2 of the registers of a distinct count, and k of a quantile summary.
REGISTERS, KLL = 12, 200
#: Three standard errors of a distinct count; the rank error of a quantile at 99 %.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2), 0.0133 * 2


def sketches(rows: DataFrame, by: list[str], id_col: str, value: str) -> DataFrame:
    """by, n, ids, values: what can be stored of each group (a key and day, say) in place of its rows,
    a HyperLogLog sketch of its ids and a KLL sketch of its values. Nulls are in neither."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(id_col, REGISTERS).alias("ids"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL).alias("values"))


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """sketches() of coarser groups, by those of finer ones, of any runs: no row is read again."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("values").alias("values"))


def estimates(stored: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5,)) -> DataFrame:
    """by, n, distinct, and an array of quantiles, null for groups that have no value."""
    some = F.kll_sketch_get_n_double("values") > 0
    return stored.select(*by, "n", F.hll_sketch_estimate("ids").alias("distinct"), F.when(some, F.kll_sketch_get_quantile_double("values", F.array(*map(F.lit, quantiles)))).alias("quantiles"))
