"""Write round trips of a store, and its scorecard as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions import topics as P
from factlake.operators import retrieval as R
from factlake.sources import folders
from factlake.sources import log as G


def round_trips(specs: DataFrame, path: str, limit: int = 5) -> DataFrame:
    """spec_id, stored, paraphrase_rank (0: not found), paraphrase_found (among the first three), update_honored, forget_honored,
    near_dup_new of specs (spec_id, fact, paraphrase, updated, near_dup, marker or null).

    All specs go through a log at `path` together, a batch for each step; each has a scope of its own, so that none sees another's facts.
    """
    spark = specs.sparkSession
    steps = folders.scratch(spark, "trips")

    def step(df, name):  # what a step finds, before the next one changes the log
        return folders.keep(df, f"{steps}/{name}")

    scope = F.col("spec_id").cast("string")
    key = lambda tail: F.concat(scope, F.lit(tail))

    def change(op, tail, text):
        payload = F.to_json(F.struct(text.alias("data"), scope.alias("user_id")))
        G.append(specs.select(F.lit(0).cast("long").alias("n"), F.lit(op).alias("op"), key(tail).alias("id"), payload.alias("payload"), F.lit("2024-01-01").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("by")), path)

    def now():
        return G.state(spark, path).select("id", F.get_json_object("payload", "$.user_id").alias("scope"), F.get_json_object("payload", "$.data").alias("data"), "created_at", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("name"))

    def has(tail, text, name):
        rows = specs.select("spec_id", key(tail).alias("id"), text.alias("text")).join(now(), "id", "left")
        return rows.select("spec_id", F.coalesce(F.contains(F.lower("data"), F.col("text")), F.lit(False)).alias(name))

    marker = F.lower(F.coalesce("marker", P.distinctive_token(F.col("fact"))))
    everything = F.lit("")
    change("upsert", "/fact", F.col("fact"))
    stored = step(has("/fact", everything, "stored"), "stored")
    asked = specs.select(F.col("spec_id").alias("query_id"), F.col("paraphrase").alias("query"), F.array(scope).alias("scopes"))
    hits = R.ranked(R.lexical_leg(asked, now(), limit), [F.desc("score"), F.col("id")])
    found = step(hits.join(specs.select(F.col("spec_id").alias("query_id"), marker.alias("marker")), "query_id").filter(F.contains(F.lower("data"), F.col("marker"))).groupBy(F.col("query_id").alias("spec_id")).agg(F.min("rank").alias("paraphrase_rank")), "found")
    change("patch", "/fact", F.col("updated"))
    updated = step(has("/fact", P.distinctive_token(F.col("updated")), "update_honored"), "updated")
    before = step(now().groupBy("scope").agg(F.count(F.lit(1)).alias("before")), "before")
    change("upsert", "/near", F.col("near_dup"))
    after = step(now().groupBy("scope").agg(F.count(F.lit(1)).alias("after")).join(before, "scope", "left").select("scope", (F.col("after") - F.coalesce("before", F.lit(0))).alias("near_dup_new")), "after")
    change("delete", "/fact", F.col("fact"))
    left = step(has("/fact", everything, "left"), "left")
    change("delete", "/near", F.col("fact"))
    out = stored.join(found, "spec_id", "left").join(updated, "spec_id").join(left, "spec_id").withColumn("scope", scope).join(after, "scope", "left")
    rank = F.coalesce("paraphrase_rank", F.lit(0)).cast("long")
    return out.select("spec_id", "stored", rank.alias("paraphrase_rank"), rank.between(1, 3).alias("paraphrase_found"), "update_honored", (~F.col("left")).alias("forget_honored"), F.coalesce("near_dup_new", F.lit(0)).alias("near_dup_new"))


def fractions(trips: DataFrame) -> DataFrame:
    """One row: n and the counts of trips that were stored, found, updated, forgotten, and of stored ones whose near copy was merged."""
    return trips.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("stored", "paraphrase_found", "update_honored", "forget_honored")], F.count_if(F.expr("stored and near_dup_new = 0")).alias("merged"))


def _money(x: float | None) -> str:
    return "—" if x is None else "$0" if x == 0 else f"${x:.4f}" if x < 0.01 else f"${x:.2f}"


def scorecard(
    names: list[str], metrics: list[DataFrame], trips: list[DataFrame], calls: DataFrame | None = None, scale: DataFrame | None = None, reach: dict[str, dict[str, str]] | None = None, seeded: DataFrame | None = None
) -> str:
    """A Markdown table of stores: each one's metrics (evaluation.by_class), fractions() and, of evaluation.measures(), latencies and costs of its calls.

    scale: evaluation.scale_curve() of the stores, by `store`. reach: what each store can and cannot do, by what is asked. seeded: store, n and failed
    of the facts that it was to take. Stores that aren't among the names are left out; what is not known is a dash.
    """
    cells: dict[str, dict[str, str]] = {}
    share = lambda x: "—" if x is None else f"{100 * x:.0f}%"
    took = lambda x: "—" if x is None else f"{x:.0f}ms"
    ours = lambda df: [] if df is None else [r for r in df.collect() if r.store in names]
    for r in ours(seeded):
        cells.setdefault("seeded (of corpus)", {})[r.store] = f"{r.n - r.failed}/{r.n}"
    for name, rows, trip in zip(names, metrics, trips):
        put = lambda label, text, name=name: cells.setdefault(label, {}).__setitem__(name, text)
        for r in sorted(rows.collect(), key=lambda r: (r["class"] != "overall", r["class"])):
            put(f"P@5 {r['class']}", share(r.p5))
            put(f"R@10 {r['class']}", share(r.r10))
            put(f"MRR {r['class']}", f"{r.mrr:.2f}")
            if r.fp is not None:
                put(f"FP {r['class']}", share(r.fp))
                put(f"median top score {r['class']}", "—" if r.median_top_score is None else f"{r.median_top_score:.3f}")
        t = fractions(trip).first()
        for label, c in (("write stored", "stored"), ("paraphrase recall (top 3)", "paraphrase_found"), ("update honored", "update_honored"), ("forget honored", "forget_honored")):
            put(label, f"{t[c]}/{t.n}")
        put("near copies", f"{t.merged}/{t.stored} merged" if t.stored else "—")
    for r in sorted(ours(calls), key=lambda r: r.call, reverse=True):
        for label, ms in ((f"{r.call} p50", r.p50), (f"{r.call} p95", r.p95)):
            cells.setdefault(label, {})[r.store] = took(ms)
        cells.setdefault(f"cost / 1k {r.call} calls", {})[r.store] = _money(r.cost_per_1k)
    for r in sorted(ours(scale), key=lambda r: r["size"]):
        cells.setdefault(f"P@5 / search p50 at {r['size']}", {})[r.store] = f"{share(r.p5)} / {took(r.p50)}"
    for asked in dict.fromkeys(k for n in names for k in (reach or {}).get(n, {})):
        cells[f"reach: {asked}"] = {n: reach[n][asked] for n in names if asked in reach.get(n, {})}
    lines = [["metric", *names], ["---"] * (1 + len(names)), *[[label, *[row.get(n, "—") for n in names]] for label, row in cells.items()]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def sweep_table(points: DataFrame) -> str:
    """A Markdown table of evaluation.sweep(); the lowest floor of the best F1 is marked."""
    rows = sorted(points.collect(), key=lambda r: r.floor)
    best = max(rows, key=lambda r: (r.f1, -r.floor), default=None)
    lines = ["| floor | precision | recall | F1 |", "| --- | --- | --- | --- |", *[f"| {r.floor:.2f}{' (best)' if r is best else ''} | {r.precision:.2f} | {r.recall:.2f} | {r.f1:.3f} |" for r in rows]]
    return "\n".join(lines)
