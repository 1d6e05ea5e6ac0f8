"""Quality of rankings against gold queries: precision, recall, reciprocal rank, floors; set-oriented, all queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factlake.operators.ranking import at_places
from factlake.sources.folders import kept


def outcomes(gold: DataFrame, expected: DataFrame, hits: DataFrame, k: int = 5, deep: int = 10) -> DataFrame:
    """One row a gold query (query_id, class): n_expected, p5, r10, rr, hit, raw_hits, top_score.

    expected: query_id, key. hits: query_id, key, rank (from 1, a query's keys distinct), score. Precision divides by k, not by the
    hits returned.
    """
    # One join and one sum, so that neither ranking nor expectation is made twice.
    wanted = expected.groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("wanted"))
    near = lambda most: F.coalesce(F.sum(F.when(F.col("rank") <= most, F.col("wanted"))), F.lit(0))
    met = hits.select("query_id", "key", "rank", "score", F.lit(1).alias("hit")).join(wanted, ["query_id", "key"], "full").groupBy("query_id").agg(
        F.coalesce(F.sum("wanted"), F.lit(0)).alias("n_expected"), F.count("hit").alias("raw_hits"), F.max("score").alias("top_score"),
        near(k).alias("near"), near(deep).alias("far"), F.min(F.when(F.col("wanted").isNotNull(), F.col("rank"))).alias("first"),
    )
    all_of = gold.join(met, "query_id", "left").fillna(0, ["n_expected", "near", "far", "raw_hits"])
    return all_of.select("query_id", "class", "n_expected", (F.col("near") / k).alias("p5"), F.try_divide("far", "n_expected").alias("r10"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("near") > 0).alias("hit"), "raw_hits", "top_score")


def upper_medians(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by and the element at half the count, counted from 0 in ascending order."""
    return at_places(rows, by, value, {name: lambda n: F.floor(n / 2) + 1})


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name, the nearest-rank percentile: the smallest value that this share of the values doesn't exceed."""
    return at_places(rows, by, value, {name: (lambda n, p=p: F.greatest(F.ceil(n * F.lit(p)), F.lit(1))) for name, p in shares.items()})


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """n, p5, r10, mrr (over queries that expect something; 0 without any), fp (share of the others with a hit) and the median top score."""
    positive = F.col("n_expected") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(positive, F.col(c))), F.lit(0.0))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), mean("p5").alias("p5"), mean("r10").alias("r10"), mean("rr").alias("mrr"), F.avg(F.when(~positive, F.when(F.col("raw_hits") > 0, 1.0).otherwise(0.0))).alias("fp"))
    return out.join(upper_medians(rows, list(by), "top_score", "median_top_score"), list(by), "left")


def by_class(rows: DataFrame) -> DataFrame:
    """metrics() of every class, and of all queries that expect something as class `overall`."""
    rows = kept(rows, "outcomes")  # medians take several passes
    return metrics(rows, "class").unionByName(metrics(rows.filter("n_expected > 0").withColumn("class", F.lit("overall")), "class"))


def precision_recall(rows: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of whole queries."""
    out = rows.groupBy(*by).agg(F.count_if(F.expr("n_expected > 0 and hit")).alias("tp"), F.count_if(F.expr("n_expected = 0 and raw_hits > 0")).alias("fp"), F.count_if(F.expr("n_expected > 0 and not hit")).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sweep(gold: DataFrame, expected: DataFrame, hits: DataFrame, floors: list[float]) -> DataFrame:
    """precision_recall() for every floor of a list. Ranks hold below any floor, as a floor only cuts a ranking's end."""
    at = lambda df: df.withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    ids = F.struct("query_id", "floor")
    keyed = lambda df: df.withColumn("query_id", ids)
    rows = outcomes(keyed(at(gold)), keyed(at(expected)).select("query_id", "key"), keyed(at(hits).filter("score >= floor")).select("query_id", "key", "rank", "score"))
    return precision_recall(rows.withColumn("floor", F.col("query_id.floor")), "floor")


def floor_points(gold: DataFrame, expected: DataFrame, hits: DataFrame, floors: list[float], exact: str = "exact-identifier") -> DataFrame:
    """floor, n, fp, r10, mrr, exact_mrr, emptied, tp, fp_queries, fn, precision, recall, f1 of a whole engine's hits at each floor (query_id, floor, key, rank, score).

    fp: the share of queries that expect nothing and get a hit. exact_mrr: the mean reciprocal rank of that class. emptied: queries that expect something
    and get nothing. The hits are those at the floor, as it may change more than a ranking's end.
    """
    at = lambda df: df.withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    keyed = lambda df: df.withColumn("query_id", F.struct("query_id", "floor")).drop("floor")
    rows = outcomes(keyed(at(gold)), keyed(at(expected)).select("query_id", "key"), keyed(hits).select("query_id", "key", "rank", "score")).withColumn("floor", F.col("query_id.floor"))
    wants = F.col("n_expected") > 0
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0))
    points = rows.groupBy("floor").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(~wants, (F.col("raw_hits") > 0).cast("double"))), F.lit(0.0)).alias("fp"), mean("r10", wants).alias("r10"), mean("rr", wants).alias("mrr"),
        mean("rr", wants & (F.col("class") == exact)).alias("exact_mrr"), F.count_if(wants & (F.col("raw_hits") == 0)).alias("emptied"),
    )
    return points.join(precision_recall(rows, "floor").withColumnRenamed("fp", "fp_queries"), "floor")


def at_sizes(hits: DataFrame, sizes: list[int], k: int = 10) -> DataFrame:
    """query_id, size, key, rank, score: each query's k best hits in a store of each size, from one search of the largest.

    hits: query_id, key, score and place: null for a store's own facts; for those layered around them the number of others before, so that a store of
    size s has those of places below s. Ties go by key. A hit's rank in a size is among hits of that size and the smaller ones, so each of these keeps
    k hits of a query before they are copied to the larger sizes.
    """
    steps = sorted(set(sizes))
    least = F.when(F.col("place").isNull(), F.lit(steps[0])).otherwise(F.array_min(F.filter(F.array(*map(F.lit, steps)), lambda s: s > F.col("place"))))
    best = lambda *by: F.row_number().over(Window.partitionBy("query_id", *by).orderBy(F.desc(F.round("score", 9)), "key"))
    own = hits.select("query_id", "key", "score", least.cast("long").alias("least")).filter("least is not null").withColumn("r", best("least")).filter(F.col("r") <= k).drop("r")
    grown = own.withColumn("size", F.explode(F.array(*[F.lit(s).cast("long") for s in steps]))).filter("size >= least").withColumn("rank", best("size").cast("long"))
    return grown.filter(F.col("rank") <= k).select("query_id", "size", "key", "rank", "score")


def scale_curve(gold: DataFrame, expected: DataFrame, hits: DataFrame, sizes: list[int], times: DataFrame | None = None) -> DataFrame:
    """size, n, p5, r10, mrr, fp, median_top_score and p50 of the gold queries in a store of each size.

    hits as for at_sizes(), which should hold ten of each query and size at least. times: size and ms of searches; without any, p50 is null.
    """
    steps = sorted(set(sizes))
    at = lambda df: df.withColumn("size", F.explode(F.array(*[F.lit(s).cast("long") for s in steps])))
    keyed = lambda df: df.withColumn("query_id", F.struct("query_id", "size")).drop("size")
    rows = outcomes(keyed(at(gold)), keyed(at(expected)).select("query_id", "key"), keyed(at_sizes(hits, steps)).select("query_id", "key", "rank", "score"))
    points = metrics(kept(rows.withColumn("size", F.col("query_id.size")), "outcomes"), "size")
    if times is None:
        return points.withColumn("p50", F.lit(None).cast("double"))
    return points.join(percentiles(times, ["size"], "ms", {"p50": 0.5}), "size", "left")


def measures(calls: DataFrame) -> DataFrame:
    """store, call, n, p50, p95 (nearest rank, of ms) and cost_per_1k of calls (store, call, ms, cost). Null and NaN times count for no percentile; costs
    that are null are none, and a kind of call without any cost has null."""
    cost = F.try_divide(F.sum("cost") * 1000, F.count(F.lit(1))).alias("cost_per_1k")
    total = calls.groupBy("store", "call").agg(F.count(F.lit(1)).alias("n"), cost)
    return total.join(percentiles(calls, ["store", "call"], "ms", {"p50": 0.5, "p95": 0.95}), ["store", "call"], "left").select("store", "call", "n", "p50", "p95", "cost_per_1k")


def best_floor(points: DataFrame) -> DataFrame:
    """The point of the highest f1, of equal ones that of the lowest floor."""
    return points.orderBy(F.desc("f1"), "floor").limit(1)
