"""Summaries and reports over answer rows and experiment rows."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import best_so_far, linear_percentiles, order_statistics


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def summary(df: DataFrame, groups: list[str], required: list[str], optional: list[str] = []) -> DataFrame:
    """AGG1, AGG2, AGG5, AGG6: (group_kind, group_value, n, f1_gt_0_5, means): overall and by each of `groups`
    as grouping sets of one aggregation. Means skip nulls: 0 for required ones without any, null for optional."""
    spark_groups = [F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias(f"g_{g}") for g in groups]
    base = df.select(*spark_groups, *{c: F.col(c) for c in [*required, *optional, "f1"]}.values())
    sets = [[], *[[F.col(f"g_{g}")] for g in groups]]
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in required] + [r6(F.avg(c), f"mean_{c}") for c in optional]
    share = r6(F.sum((F.col("f1") > 0.5).cast("int")) / F.greatest(F.count("*"), F.lit(1)), "f1_gt_0_5")
    ids = F.grouping_id().alias("gid")
    out = base.groupingSets(sets, *[F.col(f"g_{g}") for g in groups]).agg(F.count("*").alias("n"), share, *means, ids)
    full = (1 << len(groups)) - 1
    kind, value = F.lit("overall"), F.lit("all")
    for i, g in enumerate(groups):
        here = F.col("gid") == (full & ~(1 << (len(groups) - 1 - i)))
        kind, value = F.when(here, g).otherwise(kind), F.when(here, F.col(f"g_{g}")).otherwise(value)
    return out.select(kind.alias("group_kind"), value.alias("group_value"), "n", "f1_gt_0_5", *[f"mean_{c}" for c in [*required, *optional]])


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """AGG4, AGG9, AGG11: linear percentiles and moments by group and overall, without a group in one task or buffer."""
    qs = {f"p{round(q * 100)}": q for q in (0.25, 0.5, 0.75, 0.9, 0.95)}
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("whole"), F.col(by).cast("string").alias("name")), F.struct(F.lit(True).alias("whole"), F.lit("all").alias("name")))).alias("g")
    rows = df.select(kinds, F.col(value).alias("value"))
    moments = rows.groupBy("g").agg(F.count("value").alias("n"), r6(F.min("value"), "min"), r6(F.avg("value"), "mean"), r6(F.max("value"), "max"), r6(F.stddev_pop("value"), "std"))
    out = moments.join(linear_percentiles(rows, "g", "value", qs).drop("n"), "g", "left")
    return out.select(F.col("g.name").alias("group_value"), "n", "min", "mean", "max", "std", *[r6(q, q) for q in qs])


def indexed_percentile(df: DataFrame, by: str, value: str, ps: list[float]) -> DataFrame:
    """AGG10: the value at place int(n p) of the sorted ones, without interpolation."""
    places = {f"i{round(p * 100)}": F.least(F.floor(F.col("n") * p), F.col("n") - 1) for p in ps}
    return order_statistics(df, by, value, places).drop("n")


def metric_groups(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """AGG7: overall, answers under f1 0.5, and each type; overlapping groups, each with counts of non-null metrics."""
    aggs = [F.count("*").alias("n")] + [x for m in metrics for x in (F.count(F.when(~F.isnan(m), F.col(m))).alias(f"{m}_count"), r6(F.avg(F.when(~F.isnan(m), F.col(m))), f"{m}_mean"))]
    parts = [df.agg(*aggs).withColumn("grp", F.lit("overall")), df.where("f1 < 0.5").agg(*aggs).withColumn("grp", F.lit("f1_lt_0_5")), df.groupBy(F.concat(F.lit("type_"), F.coalesce(by, F.lit("unknown"))).alias("grp")).agg(*aggs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pareto(df: DataFrame, quality: str, cost: str, key: str) -> DataFrame:
    """RPT1: rows that no other row beats; equals all stay. Missing quality counts as -1, cost as 999999.

    A row is beaten if some row of no higher cost has a higher quality, or of lower cost no lower one:
    both follow from one sorted running maximum, so no pairs of rows are formed. Distinct (cost,
    quality) values are combined before the sort."""
    q, c = F.coalesce(F.col(quality), F.lit(-1.0)), F.coalesce(F.col(cost), F.lit(999999.0))
    rows = df.withColumns({"_q": q, "_c": c})
    best = rows.groupBy("_c").agg(F.max("_q").alias("_top"))  # one row a cost
    front = best_so_far(best, "_c", "_top", "_before").where(F.col("_before").isNull() | (F.col("_top") > F.col("_before")))
    return rows.join(front.select("_c", F.col("_top").alias("_q")), ["_c", "_q"], "left_semi").drop("_q", "_c")


def derived(df: DataFrame) -> DataFrame:
    """RPT2: gap between modalities, and quality over ln(1 + latency)."""
    gap = F.coalesce("multimodal_t_mean_f1", F.lit(0.0)) - F.coalesce("multimodal_f_mean_f1", F.lit(0.0))
    balanced = F.try_divide(F.coalesce("mean_f1", F.lit(0.0)), F.log1p(F.greatest(F.coalesce("latency_mean", F.lit(0.0)), F.lit(0.0))))
    return df.withColumns({"mm_gap": F.round(gap, 6), "balanced_score": F.round(balanced, 6)})


def ablation(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """RPT3: pairs (comparison, without, with) of experiments: differences and a verdict."""
    one = df.select(F.col("experiment").alias("without"), F.col("mean_f1").alias("mean_f1_no"), F.col("latency_mean").alias("latency_no"))
    two = df.select(F.col("experiment").alias("with"), F.col("mean_f1").alias("mean_f1_with"), F.col("latency_mean").alias("latency_with"))
    out = pairs.join(one, "without").join(two, "with")
    d, t = F.col("mean_f1_with") - F.col("mean_f1_no"), F.col("latency_with") - F.col("latency_no")
    verdict = F.when((d > 0) & (t > 0), "Quality improves, latency increases").otherwise("Mixed")
    return out.select("comparison", "mean_f1_no", "mean_f1_with", r6(d, "delta_mean_f1"), "latency_no", "latency_with", r6(t, "delta_latency"), verdict.alias("verdict"))


def ablation_summary(deltas: DataFrame) -> DataFrame:
    """AGG14; of equal ones the first comparison."""
    first = lambda order: F.min_by("comparison", F.struct(order, "comparison"))
    return deltas.agg(r6(F.avg("delta_mean_f1"), "mean_delta_f1"), r6(F.avg("delta_latency"), "mean_delta_latency"), first(-F.col("delta_mean_f1")).alias("best_f1_gain"), first(F.col("delta_latency")).alias("least_latency"))


def best_experiment(order: Column, eligible: Column | bool = True) -> Column:
    """The experiment that comes first in an order, by name among equals; if none is eligible, of all."""
    eligible = eligible if isinstance(eligible, Column) else F.lit(eligible)
    return F.min_by("experiment", F.struct(~F.coalesce(eligible, F.lit(False)), order, F.col("experiment")))


def component_aggregation(df: DataFrame, components: dict[str, str]) -> DataFrame:
    """AGG12, AGG13: by component (name: column) and value: experiments, mean and best f1, means of the share over 0.5, of
    both modalities and of the latency, and the best experiment; missing values are "unknown", missing f1 counts as -1."""
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("component"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for name, c in components.items()])).alias("x")
    out = df.select("*", kinds).groupBy("x.component", "x.value")
    means = {"mean_f1": "mean_mean_f1", "f1_gt_0_5": "mean_f1_gt_0_5", "multimodal_t_mean_f1": "mean_mm_t_f1", "multimodal_f_mean_f1": "mean_mm_f_f1", "latency_mean": "mean_latency"}
    return out.agg(F.count("*").alias("count_experiments"), r6(F.max("mean_f1"), "max_mean_f1"), *[r6(F.avg(c), to) for c, to in means.items()], best_experiment(-F.coalesce("mean_f1", F.lit(-1.0))).alias("best_experiment"))


def modality_by(df: DataFrame, by: str) -> DataFrame:
    """AGG13: modalities by a component: means of both and of their gap, and the best experiment on figures."""
    out = derived(df).groupBy(F.coalesce(by, F.lit("unknown")).alias(by))
    best = best_experiment(-F.coalesce("multimodal_f_mean_f1", F.lit(-1.0)))
    return out.agg(F.count("*").alias("count_experiments"), r6(F.avg("multimodal_t_mean_f1"), "mean_mm_t_f1"), r6(F.avg("multimodal_f_mean_f1"), "mean_mm_f_f1"), r6(F.avg("mm_gap"), "mean_mm_gap"), best.alias("best_mmf_experiment"))


def _listed(df: DataFrame, picks: dict[str, Column]) -> DataFrame:
    one = df.agg(*[p.alias(name) for name, p in picks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("category"), F.col(name).alias("experiment")) for name in picks])).alias("x")
    return one.select(rows).select("x.*").where("experiment is not null")


def recommendations(df: DataFrame) -> DataFrame:
    """RPT4: (category, experiment): best quality; fastest from f1 0.65; best balance of f1 and latency; best text baseline
    (family BM25 text reranking, else Text evidence encoder); best without a reranker. If none is eligible, all are."""
    quality, slow = -F.coalesce("mean_f1", F.lit(-1.0)), F.coalesce("latency_mean", F.lit(999999.0))
    text = F.col("family").isin("BM25 text reranking", "Text evidence encoder")
    baseline = F.struct(F.when(F.col("family") == "BM25 text reranking", 0).when(text, 1).otherwise(2), quality)
    return _listed(derived(df), {"Best quality": best_experiment(quality), "Best speed": best_experiment(slow, F.col("mean_f1") >= 0.65), "Best balanced": best_experiment(-F.coalesce("balanced_score", F.lit(-1.0))), "Best text-only baseline": best_experiment(baseline), "Best no-reranker variant": best_experiment(quality, F.col("reranker") == "None")})


def choices(df: DataFrame) -> DataFrame:
    """TOP6: (category, experiment): best quality; fastest within 0.01 of it; best balance from f1 0.67; fastest from 0.65."""
    out = derived(df).crossJoin(F.broadcast(df.agg(F.max("mean_f1").alias("top"))))
    q, t = F.col("mean_f1"), F.col("latency_mean")
    only = lambda order, cond: F.min_by(F.when(cond, F.col("experiment")), F.when(cond, F.struct(order, F.col("experiment"))))
    return _listed(out, {"best": best_experiment(-q), "near_best_fast": only(t, q >= F.col("top") - 0.01), "balanced": only(-F.col("balanced_score"), q >= 0.67), "fast": only(t, q >= 0.65)})


def route_report(df: DataFrame) -> DataFrame:
    """AGG16: rows (route, skipped, f1, latency, rerank_latency) by route and overall: questions, means, skipped ones and their share."""
    aggs = [F.count("*").alias("questions"), r6(F.avg("f1"), "mean_f1"), r6(F.avg("latency"), "mean_latency"), r6(F.avg("rerank_latency"), "mean_rerank_latency"), F.count_if("skipped").alias("skipped"), r6(F.count_if("skipped") / F.greatest(F.count("*"), F.lit(1)), "skipped_share")]
    out = df.select(F.col("route"), "skipped", "f1", "latency", "rerank_latency").groupingSets([[], [F.col("route")]], F.col("route")).agg(*aggs, F.grouping_id().alias("gid"))
    return out.withColumn("route", F.when(F.col("gid") == 1, "all").otherwise(F.coalesce("route", F.lit("unknown")))).drop("gid")


def compare_runs(base: DataFrame, new: DataFrame, key: str = "query_id") -> DataFrame:
    """RPT6: improved, regressed, unchanged and still bad answers of two runs, overall and by type."""
    j = base.select(key, "qtype", F.col("f1").alias("b")).join(new.select(key, F.col("f1").alias("n")), key)
    d = F.col("n") - F.col("b")
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    aggs = [F.count("*").alias("n"), count(d > 0, "improved"), count(d < 0, "regressed"), count(d == 0, "unchanged"), count((F.col("b") < 0.5) & (F.col("n") < 0.5), "still_bad"), r6(F.avg(d), "mean_delta")]
    return j.groupBy("qtype").agg(*aggs).unionByName(j.agg(*aggs).withColumn("qtype", F.lit("all")))


def threshold_grid(stats: DataFrame, grid: DataFrame) -> DataFrame:
    """ORC4, RPT9: skip decisions of all queries under all threshold pairs (t1, gap_t), in one job."""
    from ..functions.intent import skip_reason

    out = stats.crossJoin(F.broadcast(grid)).withColumn("reason", skip_reason(F.col("top1"), F.col("top2"), F.col("t1"), F.col("gap_t")))
    return out.groupBy("t1", "gap_t").agg(F.count("*").alias("n"), F.sum((F.col("reason") == "top1_and_gap_passed").cast("long")).alias("skipped"), r6(F.avg((F.col("reason") == "top1_and_gap_passed").cast("double")), "skip_rate"))


def grid_rows(df: DataFrame, baselines: dict[str, tuple[float, float]]) -> DataFrame:
    """RPT8: a row a pair of thresholds (t1, gap_t): means, percentiles of the latency, skips, and the differences to baselines
    (name: mean f1, mean latency). df: (t1, gap_t, f1, exact_match, qtype, latency, skipped), a row a question and pair."""
    rows = df.withColumn("cell", F.struct("t1", "gap_t"))
    f1 = F.col("f1")
    modality = lambda kind: F.avg(F.when(F.col("qtype") == kind, f1))
    out = rows.groupBy("cell").agg(
        F.avg("f1").alias("f"), r6(F.avg("exact_match"), "exact_match"), r6(F.avg((f1 > 0.5).cast("double")), "f1_gt_0_5"), r6(modality("multimodal-t"), "mm_t_f1"), r6(modality("multimodal-f"), "mm_f_f1"), F.avg("latency").alias("l"),
        r6(F.avg(F.col("skipped").cast("double")), "skip_rate"), F.count_if("skipped").alias("number_skipped"), F.count_if(~F.col("skipped")).alias("number_reranked"),
    )
    out = out.join(linear_percentiles(rows, "cell", "latency", {"latency_p50": 0.5, "latency_p95": 0.95}).drop("n"), "cell", "left")
    deltas = [x for name, (q, t) in baselines.items() for x in (r6(F.col("f") - q, f"quality_delta_vs_{name}"), r6(F.col("l") - t, f"latency_delta_vs_{name}"))]
    kept = ["exact_match", "f1_gt_0_5", "mm_t_f1", "mm_f_f1", "skip_rate", "number_skipped", "number_reranked"]
    return out.select("cell.*", r6("f", "mean_f1"), r6("l", "latency_mean"), *kept, r6("latency_p50", "latency_p50"), r6("latency_p95", "latency_p95"), *deltas)


def case_rows(df: DataFrame, f1_below: float = 0.5) -> DataFrame:
    """SNK2: answers under a score, with a suspected error."""
    from ..operators.answer_metrics import suspected_error

    return df.where(F.col("f1") < f1_below).withColumn("error_type", suspected_error(df))


def family(c: Column) -> Column:
    """RPT5: a retriever's family, by the first rule that holds."""
    t = F.lower(F.coalesce(c, F.lit("")))
    has = lambda *xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.contains(t, x))
    return F.when(has("multivector", "colvision"), "multi-vector").when(has("image"), "image embedding").when(has("encoder"), "text embedding").when(has("bm25"), "bm25").otherwise("other")


MOST_ROWS = 10_000  # of a table that becomes text on the driver


def _few_rows(df: DataFrame, columns: list[str]) -> list:
    rows = df.select(*columns).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows: write the table with Spark")
    return rows


def markdown(df: DataFrame, columns: list[str]) -> str:
    """SNK4: a small table as Markdown; pipes are escaped."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    rows = [[cell(r[c]) for c in columns] for r in _few_rows(df, columns)]
    return "\n".join("| " + " | ".join(r) + " |" for r in [columns, ["---"] * len(columns), *rows])


def delimited(df: DataFrame, columns: list[str], separator: str = ",") -> str:
    """SNK4: a small table as CSV or TSV."""
    out = io.StringIO()
    w = csv.writer(out, delimiter=separator, lineterminator="\n")
    w.writerow(columns)
    w.writerows([["" if v is None else v for v in r] for r in _few_rows(df, columns)])
    return out.getvalue()
