"""Semantic-cache lookups, thresholds and evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.functions.scoring import confidence, overlap
from fleetscope.operators.knn import knn
from fleetscope.operators.quantiles import Quantile, exact_quantiles


def category_threshold(category: Column, default: float, per_category: Mapping[str, float]) -> Column:
    """Threshold of a category, or the default."""
    if not per_category:
        return F.lit(default)
    table = F.create_map(*[x for c, v in per_category.items() for x in (F.lit(c), F.lit(v))])
    return F.coalesce(table[category], F.lit(default))


def decide(
    nearest: DataFrame,
    default: float,
    per_category: Mapping[str, float] | None = None,
    band: float = 0.05,
    call_threshold: Column | None = None,
) -> DataFrame:
    """Hit, uncertain hit or miss of each query from its nearest entry's distance.

    Call threshold, then category threshold, then default. ``nearest`` has (query_id, category, distance).
    """
    threshold = category_threshold(F.col("category"), default, per_category or {})
    if call_threshold is not None:
        threshold = F.coalesce(call_threshold, threshold)
    hit = F.coalesce(F.col("distance") <= F.col("threshold"), F.lit(False))
    return nearest.withColumn("threshold", threshold).withColumns(
        {
            "hit": hit,
            "confidence": F.when(~hit, "miss")
            .when(F.col("distance") >= F.col("threshold") - F.lit(band), "uncertain")
            .otherwise("high"),
            "delta_to_threshold": F.when(~hit, F.col("distance") - F.col("threshold")),
        }
    )


def cache_lookup(
    queries: DataFrame,
    entries: DataFrame,
    default: float,
    per_category: Mapping[str, float] | None = None,
    band: float = 0.05,
    k: int = 1,
    where: Column | None = None,
) -> DataFrame:
    """Nearest cached entry per query with its decision; queries without candidates are misses.

    ``queries`` has (query_id, embedding, category); ``entries`` (entry_id, embedding).
    """
    top = knn(queries, entries, k, where).where(F.col("rank") == 1)
    joined = queries.select("query_id", "category").join(top, "query_id", "left").drop("rank")
    return decide(joined, default, per_category, band)


def rerank_keyword(
    candidates: DataFrame, query_tokens: str, candidate_tokens: str, weight: float = 0.7
) -> DataFrame:
    """Best candidate per query by blended similarity and word overlap; the first best wins.

    The hit gate stays with the top-1 distance, which is returned beside the pick.
    ``candidates`` has (query_id, entry_id, distance, rank) and the token sets of both texts,
    made once per text.
    """
    blended = F.lit(weight) * (F.lit(1.0) - F.col("distance")) + F.lit(1.0 - weight) * overlap(
        F.col(query_tokens), F.col(candidate_tokens)
    )
    scored = candidates.withColumn("score", blended)
    return scored.groupBy("query_id").agg(
        F.min_by("entry_id", F.struct(-F.col("score"), F.col("rank"))).alias("entry_id"),
        F.max("score").alias("score"),
        F.min_by("distance", F.struct(-F.col("score"), F.col("rank"))).alias("distance"),
        F.min_by("distance", "rank").alias("gate_distance"),
    )


def hybrid_rerank(pool: DataFrame, query_tokens: str, tokens: str, weight: float = 0.7) -> DataFrame:
    """Reorder each query's pool by dense similarity and word overlap: adds score and position.

    The token columns are sets made once per text, before texts meet in pools.
    """
    blended = F.lit(weight) * (F.lit(1.0) - F.col("distance")) + F.lit(1.0 - weight) * overlap(
        F.col(query_tokens), F.col(tokens)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")  # over one small pool
    return pool.withColumn("score", blended).withColumn("position", F.row_number().over(order).cast("bigint"))


def stale_model(hits: DataFrame, current_model: str) -> tuple[DataFrame, DataFrame]:
    """Hits on an entry of another model become misses; second result lists the entries to evict."""
    stale = F.col("hit") & (F.coalesce("model", F.lit("")) != "") & (F.col("model") != current_model)
    marked = hits.withColumn("stale", F.coalesce(stale, F.lit(False)))
    checked = marked.withColumn("hit", F.col("hit") & ~F.col("stale")).withColumn(
        "confidence", F.when(F.col("stale"), "miss").otherwise(F.col("confidence"))
    )
    return checked, marked.where("stale").select("entry_id").distinct()


def apply_verdicts(hits: DataFrame, verdicts: DataFrame, on_error: str = "accept") -> DataFrame:
    """Judge verdicts (query_id, verdict accept|reject|error) applied to uncertain hits; no verdict is an error."""
    joined = hits.join(verdicts, "query_id", "left")
    judged = F.col("confidence") == "uncertain"
    verdict = F.coalesce("verdict", F.lit("error"))
    rejected = judged & ((verdict == "reject") | ((verdict == "error") & F.lit(on_error == "reject")))
    return joined.select(
        *[c for c in hits.columns if c not in ("hit", "confidence")],
        (F.col("hit") & ~rejected).alias("hit"),
        F.when(rejected, "miss")
        .when(judged & (verdict == "accept"), "high")
        .otherwise(F.col("confidence"))
        .alias("confidence"),
    )


def invalidate(entries: DataFrame, condition: Column) -> DataFrame:
    """Entries left after removing those that meet the condition."""
    return entries.where(~F.coalesce(condition, F.lit(False)))


def recent_samples(samples: DataFrame, now_ms: int, days: int = 7, keep: int = 10_000) -> DataFrame:
    """Rolling similarity window: the newest ``keep`` samples of the last days."""
    inside = samples.where(F.col("ts_ms") > now_ms - days * 86_400_000)
    return inside.orderBy(F.desc("ts_ms"), F.desc("id")).limit(keep)


def _nano(score: Column) -> Column:
    return F.round(score * 1e9).cast("bigint")


def _per_category(samples: DataFrame) -> DataFrame:
    """Each sample once under its category and once under ``all``."""
    scopes = F.array_distinct(F.array(F.col("category"), F.lit("all")))
    return samples.withColumn("scope", F.explode(scopes)).where(F.col("scope") != "")


def _exact_sum(units: Column) -> Column:
    """Sum of whole units without a 64-bit limit."""
    return F.sum(units.cast("decimal(19,0)")).cast("double")


def threshold_effectiveness(
    samples: DataFrame,
    default: float,
    per_category: Mapping[str, float] | None = None,
    band: float = 0.05,
    min_samples: int = 100,
) -> DataFrame:
    """Rates around the threshold per category and overall, with advice.

    Score means come from exact sums of 10^-9 units.
    """
    threshold = category_threshold(F.col("scope"), default, per_category or {})
    rows = _per_category(samples).withColumn("t", threshold)
    hit = F.col("result") == "hit"
    near = ~hit & (F.col("score") > F.col("t")) & (F.col("score") <= F.col("t") + F.lit(0.03))
    nano, t_nano = _nano(F.col("score")), _nano(F.col("t"))
    stats = rows.groupBy("scope", F.col("t").alias("threshold")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(hit).alias("hits"),
        F.count_if(hit & (F.col("score") >= F.col("t") - F.lit(band))).alias("uncertain"),
        F.count_if(near).alias("near"),
        _exact_sum(F.when(hit, nano)).alias("hit_sum"),
        _exact_sum(F.when(~hit, nano)).alias("miss_sum"),
        _exact_sum(F.when(near, nano - t_nano)).alias("near_sum"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    misses = F.col("samples") - F.col("hits")
    enough = F.col("samples") >= min_samples
    uncertain_rate = ratio(F.col("uncertain"), F.col("hits"))
    near_rate = ratio(F.col("near"), misses)
    near_delta = ratio(F.col("near_sum"), F.col("near")) / F.lit(1e9)
    tighten = uncertain_rate > 0.2
    loosen = ~tighten & (near_rate > 0.3) & (near_delta < 0.03)
    advice = (
        F.when(~enough, "insufficient_data")
        .when(tighten, "tighten_threshold")
        .when(loosen, "loosen_threshold")
        .otherwise("optimal")
    )
    target = F.when(tighten, F.greatest(F.lit(0.0), F.col("threshold") - F.lit(band * 1.5))).when(
        loosen, F.col("threshold") + near_delta
    )
    rate = lambda c: F.when(enough, c).otherwise(F.lit(0.0))
    return stats.select(
        F.col("scope").alias("category"),
        "samples",
        "threshold",
        rate(F.col("hits") / F.col("samples")).alias("hit_rate"),
        rate(uncertain_rate).alias("uncertain_hit_rate"),
        rate(near_rate).alias("near_miss_rate"),
        rate(ratio(F.col("hit_sum"), F.col("hits")) / F.lit(1e9)).alias("avg_hit_score"),
        rate(ratio(F.col("miss_sum"), misses) / F.lit(1e9)).alias("avg_miss_score"),
        advice.alias("recommendation"),
        F.when(enough, target).alias("recommended_threshold"),
    )


# Limits of the tuning advice.
RECALL_COST_MAX = 0.15
VELOCITY_CAP = 5
OSCILLATION_CAP = 3
SIGNAL_BOUNDARY = {"uncertain_hits": 0.2, "distant_hits": 0.25, "near_misses": 0.25, "low_hit_rate": 0.1}


def threshold_recommendation(
    samples: DataFrame,
    default: float,
    per_category: Mapping[str, float] | None = None,
    band: float = 0.05,
    min_samples: int = 100,
    cost_weighted: bool = False,
    history: DataFrame | None = None,
    outcomes: DataFrame | None = None,
    now_ms: int | None = None,
) -> DataFrame:
    """Tuning advice per category and overall, guarded by recall cost, past outcome and velocity.

    ``history`` has (category, ts_ms, direction, signal, metric_before): past adjustments;
    ``outcomes`` (signal, degraded, improved): how past proposals of a signal turned out.
    Each guard can only turn advice into ``optimal`` or shorten its step.
    """
    threshold = category_threshold(F.col("scope"), default, per_category or {})
    rows = _per_category(samples).withColumn("t", threshold)
    hit, score, t = F.col("result") == "hit", F.col("score"), F.col("t")
    uncertain = hit & (score >= t - F.lit(band))
    near = ~hit & (score > t) & (score <= t + F.lit(band))
    close = ~hit & (score > t) & (score <= t + F.lit(band * 2))
    costed, cost = F.col("cost_micros").isNotNull(), F.col("cost_micros")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    stats = rows.groupBy("scope", "t").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(hit).alias("hits"),
        F.count_if(uncertain).alias("uncertain"),
        F.count_if(hit & (score > t / 2)).alias("distant"),
        F.count_if(near).alias("near"),
        F.count_if(close).alias("close"),
        F.sum(F.when(near, _nano(score) - _nano(t))).alias("near_sum"),
        F.count_if(hit & costed).alias("costed_hits"),
        F.count_if(~hit & costed).alias("costed_misses"),
        zero(F.sum(F.when(hit, cost))).alias("hit_cost"),
        zero(F.sum(F.when(~hit, cost))).alias("miss_cost"),
        zero(F.sum(F.when(uncertain, cost))).alias("uncertain_cost"),
        zero(F.sum(F.when(near, cost))).alias("near_cost"),
        F.max("ts_ms").alias("latest_ms"),
    )
    p75 = exact_quantiles(rows.where(hit), ["scope"], "score", [Quantile("p75", "floor", 0.75)]).drop("n")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    by_cost_hits = F.lit(cost_weighted) & (F.col("costed_hits") >= min_samples)
    by_cost_misses = F.lit(cost_weighted) & (F.col("costed_misses") >= min_samples)
    misses = F.col("samples") - F.col("hits")
    rated = stats.join(p75, "scope", "left").withColumns(
        {
            "hit_rate": F.col("hits") / F.col("samples"),
            "uncertain_rate": F.when(by_cost_hits, ratio(F.col("uncertain_cost"), F.col("hit_cost"))).otherwise(
                ratio(F.col("uncertain"), F.col("hits"))
            ),
            "distant_rate": ratio(F.col("distant"), F.col("hits")),
            "near_rate": F.when(by_cost_misses, ratio(F.col("near_cost"), F.col("miss_cost"))).otherwise(
                ratio(F.col("near"), misses)
            ),
            "close_rate": ratio(F.col("close"), misses),
            "near_delta": ratio(F.col("near_sum"), F.col("near")) / F.lit(1e9),
            "uncertain_of_all": F.when(
                by_cost_hits, ratio(F.col("uncertain_cost"), F.col("hit_cost") + F.col("miss_cost"))
            ).otherwise(ratio(F.col("uncertain"), F.col("hits")) * (F.col("hits") / F.col("samples"))),
        }
    )
    c = F.col
    first = c("uncertain_rate") > 0.2
    second = ~first & (c("distant_rate") > 0.25) & (c("hits") >= 20)
    third = ~first & ~second & (c("near_rate") > 0.25)
    fourth = ~first & ~second & ~third & (c("hit_rate") < 0.05) & (misses >= 20)
    signal = (
        F.when(first & (c("uncertain_of_all") > 0.15), "uncertain_hits")
        .when(second & (c("hit_rate") > 0.8), "distant_hits")
        .when(third, "near_misses")
        .when(fourth & (c("close_rate") > 0.1), "low_hit_rate")
    )
    step = F.lit(band * 0.6)
    target = (
        F.when(c("signal") == "uncertain_hits", F.greatest(F.lit(0.0), t - step))
        .when(
            c("signal") == "distant_hits",
            F.least(t, F.greatest(t - F.lit(band * 2), F.greatest(F.lit(0.0), c("p75") + F.lit(band * 0.3)))),
        )
        .when(c("signal") == "near_misses", t + c("near_delta"))
        .when(c("signal") == "low_hit_rate", t + step)
    )
    signalled = (
        rated.withColumn("signal", F.when(c("samples") >= min_samples, signal))
        .withColumn("target", target)
        .withColumn("direction", F.when(c("signal").isin("uncertain_hits", "distant_hits"), "tighten").when(c("signal").isNotNull(), "loosen"))
    )
    # Recall cost: the share of present hits a tighter threshold would lose.
    proposals = signalled.where(c("direction") == "tighten").select("scope", "target")
    lost = (
        rows.where(hit)
        .join(proposals, "scope")
        .groupBy("scope")
        .agg((F.count_if((score > c("target")) & (score <= t)) / F.count(F.lit(1))).alias("recall_cost"))
    )
    guarded = signalled.join(lost, "scope", "left").withColumn(
        "blocked_by", F.when(c("recall_cost") > RECALL_COST_MAX, "recall_cost")
    )
    rate_of = (
        F.when(c("signal") == "uncertain_hits", c("uncertain_rate"))
        .when(c("signal") == "distant_hits", c("distant_rate"))
        .when(c("signal") == "near_misses", c("near_rate"))
        .when(c("signal") == "low_hit_rate", c("close_rate"))
    )
    guarded = guarded.withColumn("signal_rate", rate_of)
    if history is not None:
        guarded = _with_history(guarded, history)
    else:
        guarded = guarded.withColumn("dampening", F.lit(1.0))
    if outcomes is not None:
        bad = outcomes.select("signal", ((c("degraded") >= 2) & (c("degraded") > c("improved"))).alias("_bad"))
        guarded = guarded.join(bad, "signal", "left").withColumn(
            "blocked_by",
            F.coalesce("blocked_by", F.when(F.coalesce("_bad", F.lit(False)), "signal_ineffective")),
        )
    open_ = c("signal").isNotNull() & c("blocked_by").isNull()
    stepped = F.when(
        c("dampening") < 1,
        F.when(c("direction") == "tighten", F.greatest(F.lit(0.0), t - F.abs(c("target") - t) * c("dampening"))).otherwise(
            t + F.abs(c("target") - t) * c("dampening")
        ),
    ).otherwise(c("target"))
    boundary = F.create_map(*[x for k, v in SIGNAL_BOUNDARY.items() for x in (F.lit(k), F.lit(v))])[c("signal")]
    out = guarded.select(
        c("scope").alias("category"),
        "samples",
        c("t").alias("threshold"),
        F.when(c("samples") < min_samples, "insufficient_data").when(open_, c("direction")).otherwise("optimal").alias("recommendation"),
        F.when(open_, stepped).alias("recommended_threshold"),
        F.when(open_, c("signal")).alias("signal"),
        "blocked_by",
        F.when(open_, c("signal_rate")).alias("signal_rate"),
        F.when(
            open_,
            confidence(c("samples"), c("signal_rate"), boundary, F.lit(now_ms) - c("latest_ms") if now_ms is not None else F.lit(0)),
        ).alias("confidence"),
    )
    return out


def _with_history(guarded: DataFrame, history: DataFrame) -> DataFrame:
    """Outcome check, velocity and oscillation limits from the recorded adjustments of a category.

    A category's record is bounded by the tuning cooldown, so it is read as one ordered array.
    """
    c = F.col
    entry = F.struct("ts_ms", "direction", "signal", "metric_before")
    past = history.groupBy(c("category").alias("scope")).agg(
        F.reverse(F.array_sort(F.collect_list(entry))).alias("past")
    )
    joined = guarded.join(past, "scope", "left").withColumn("past", F.coalesce("past", F.array()))
    run = F.aggregate(
        "past",
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct(
            (s["n"] + F.when(s["on"] & (e["direction"] == c("direction")), 1).otherwise(0)).alias("n"),
            (s["on"] & (e["direction"] == c("direction"))).alias("on"),
        ),
    )["n"]
    turns = F.transform(F.concat(F.array(c("direction")), F.transform("past", lambda e: e["direction"])), lambda d: d)
    flips = F.size(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(turns) - 1, F.lit(1))), lambda i: F.coalesce(F.get(turns, i) != F.get(turns, i - 1), F.lit(False)))
    )
    same = F.try_element_at(F.filter("past", lambda e: (e["direction"] == c("direction")) & e["metric_before"].isNotNull() & e["signal"].isNotNull()), F.lit(1))
    now = (
        F.when(c("_same.signal") == "uncertain_hits", c("uncertain_rate"))
        .when(c("_same.signal") == "distant_hits", c("distant_rate"))
        .when(c("_same.signal") == "near_misses", c("near_rate"))
        .when(c("_same.signal") == "low_hit_rate", c("hit_rate"))
    )
    before = c("_same.metric_before")
    improved = F.when(c("_same.signal") == "low_hit_rate", now > before * 1.2).otherwise(now < before * 0.8)
    return (
        joined.withColumn("_same", same)
        .withColumn("_run", run)
        .withColumn("_flips", flips)
        .withColumn(
            "blocked_by",
            F.coalesce(
                "blocked_by",
                F.when(now.isNotNull() & ~improved, "last_adjustment_ineffective")
                .when(c("_run") >= VELOCITY_CAP, "velocity")
                .when(c("_flips") >= OSCILLATION_CAP, "oscillation"),
            ),
        )
        .withColumn("dampening", F.lit(1.0) / (1 + c("_run") * 0.5))
        .drop("past", "_same", "_run", "_flips")
    )


def confusion_metrics(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, precision, recall, F1, false-positive and hit rate of replayed lookups.

    ``results`` has (expected boolean, hit boolean) and the keys to group by.
    """
    e, h = F.col("expected"), F.col("hit")
    counted = results.groupBy(*keys).agg(
        F.count_if(e & h).alias("tp"),
        F.count_if(~e & h).alias("fp"),
        F.count_if(~e & ~h).alias("tn"),
        F.count_if(e & ~h).alias("fn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    both = F.col("precision") + F.col("recall")
    return (
        counted.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", F.when(both > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
        .withColumn("fpr", ratio(fp, fp + tn))
        .withColumn("hit_rate", ratio(tp + fp, tp + fp + tn + fn))
    )


def latency_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated latency percentiles."""
    wanted = [Quantile(f"p{p}", "linear", p / 100) for p in (50, 95, 99)]
    return exact_quantiles(results, list(keys), "latency", wanted)


def threshold_sweep(nearest: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Confusion metrics at each threshold; ``nearest`` has (expected, distance).

    Distances are counted per interval between thresholds first, so rows are read once and
    not copied per threshold.
    """
    cuts = sorted(thresholds)
    slot = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        slot = F.when(F.col("distance") <= F.lit(cuts[i]), i).otherwise(slot)
    counts = nearest.groupBy(F.coalesce(slot, F.lit(len(cuts))).alias("slot"), "expected").agg(F.count(F.lit(1)).alias("n"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("threshold")) for i, v in enumerate(cuts)]))
    spread = counts.select("slot", "expected", "n", at.alias("a")).select(
        F.col("a.threshold").alias("threshold"), "expected", (F.col("slot") <= F.col("a.i")).alias("hit"), "n"
    )
    e, h, n = F.col("expected"), F.col("hit"), F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    wide = spread.groupBy("threshold").agg(
        total(e & h).alias("tp"), total(~e & h).alias("fp"), total(~e & ~h).alias("tn"), total(e & ~h).alias("fn")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    both = F.col("precision") + F.col("recall")
    return (
        wide.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", F.when(both > 0, F.lit(2.0) * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
        .withColumn("fpr", ratio(fp, fp + tn))
        .withColumn("hit_rate", ratio(tp + fp, tp + fp + tn + fn))
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Threshold of the highest F1; the lowest one on ties."""
    return sweep.agg(
        F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1")
    )


def recall_at_k(retrieved: DataFrame, evidence: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Share of questions with evidence among the first ``k``, by question type and overall.

    ``retrieved`` has (query_id, position, session_id); ``evidence`` (query_id, session_id);
    ``questions`` (query_id, question_type).
    """
    found = (
        retrieved.where(F.col("position") <= k)
        .join(evidence.distinct(), ["query_id", "session_id"], "left_semi")
        .select("query_id")
        .distinct()
        .withColumn("_hit", F.lit(1))
    )
    judged = questions.join(found, "query_id", "left")
    return (
        judged.groupingSets([("question_type",), ()], "question_type")
        .agg(F.count(F.lit(1)).alias("questions"), F.count("_hit").alias("recalled"))
        .select(
            F.coalesce("question_type", F.lit("(all)")).alias("question_type"),
            "questions",
            "recalled",
            (F.col("recalled") / F.col("questions")).alias("recall"),
        )
    )
