"""Vector, semantic-cache, memory and retrieval queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.catalog import walks
from fleetscope.catalog.registry import query
from fleetscope.catalog.views import ORIGIN_MS, Tables
from fleetscope.functions.scoring import cosine_distance, token_set
from fleetscope.operators import descent
from fleetscope.operators import knn as N
from fleetscope.operators import memory as M
from fleetscope.operators import semantic as S
from fleetscope.plans import retrieval_eval as R

DAY = 86_400_000
NOW = 1_736_000_000_000
HALF_LIFE = 604_800.0
_DIST = "1 - list_dot_product({a}, {b})/(sqrt(list_dot_product({a}, {a}))*sqrt(list_dot_product({b}, {b})))"


def queries(t: Tables):
    return t.vec.where(F.col("side") == "query").select(F.col("vec_id").alias("query_id"), "embedding", "category", "label", "model")


def entries(t: Tables):
    return t.vec.where(F.col("side") == "entry").select(F.col("vec_id").alias("entry_id"), "embedding", "category", "label", "model", "cost_micros")


PAIRS = f"""q AS (SELECT vec_id AS query_id, embedding, category, label FROM v_vec WHERE side = 'query'),
  e AS (SELECT vec_id AS entry_id, embedding, category, label, model, cost_micros FROM v_vec WHERE side = 'entry'),
  d AS (SELECT query_id, entry_id, q.category, q.label, e.category AS ecat, e.label AS elabel, e.model, e.cost_micros, round({_DIST.format(a='q.embedding', b='e.embedding')}, 12) AS distance FROM q, e),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, entry_id) AS rank FROM d)"""
_R9 = lambda c="distance": F.round(c, 6).alias(c)


@query("knn", "V1 P12", f"WITH {PAIRS} SELECT query_id, entry_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5")
def _knn(t: Tables):
    return N.knn(queries(t), entries(t), 5).select("query_id", "entry_id", _R9(), "rank")


@query(
    "knn_filtered",
    "V1",
    f"""WITH {PAIRS} SELECT query_id, entry_id, round(distance, 6) AS distance, rank FROM (SELECT query_id, entry_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, entry_id) AS rank
    FROM d WHERE category = ecat AND cost_micros < 700) WHERE rank <= 3""",
)
def _knn_filtered(t: Tables):
    found = N.knn(queries(t), entries(t), 3, where=F.col("cost_micros") < 700, match_on=["category"])
    return found.select("query_id", "entry_id", _R9(), "rank")


@query(
    "knn_pivots",
    "V1",
    f"WITH {PAIRS} SELECT query_id, entry_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 2",
)
def _knn_pivots(t: Tables):
    return N.knn(queries(t), entries(t), 2, pivots=16).select("query_id", "entry_id", _R9(), "rank")


@query("knn_lsh_recall", "V1", "SELECT 5*count(*) AS neighbours, true AS recall_above_half FROM v_vec WHERE side = 'query'")
def _lsh(t: Tables):
    exact = N.knn(queries(t), entries(t), 5)
    found = N.lsh_recall(exact, N.knn_lsh(queries(t), entries(t), 5, dims=64, tables=24, bits=4))
    return found.select("neighbours", (F.col("found") / F.col("neighbours") > 0.5).alias("recall_above_half"))


@query(
    "knn_descent_recall",
    "V24",
    "SELECT 5*count(*) AS neighbours, true AS nine_tenths_found FROM v_vec WHERE vec_id % 20 = 0",
)
def _descent(t: Tables):
    items = t.vec.select(F.col("vec_id").alias("item_id"), "embedding")
    asked = items.where(F.col("item_id") % 20 == 0).withColumnRenamed("item_id", "query_id")
    near = N.knn(asked, items.withColumnRenamed("item_id", "entry_id"), 6).where(F.col("query_id") != F.col("entry_id"))
    order = Window.partitionBy("query_id").orderBy("rank")
    exact = near.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= 5)
    found = N.lsh_recall(exact, descent.knn_descent(items, 5))
    return found.select("neighbours", (F.col("found") >= F.col("neighbours") * 0.9).alias("nine_tenths_found"))


@query(
    "cosine_to_previous",
    "P12",
    f"SELECT a.vec_id, round({_DIST.format(a='a.embedding', b='b.embedding')}, 9) AS distance FROM v_vec a JOIN v_vec b ON b.vec_id = a.vec_id - 1",
)
def _cosine(t: Tables):
    before = t.vec.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("_e"))
    return t.vec.join(before, "vec_id").select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("_e")), 9).alias("distance"))


THRESHOLDS = {"cat1": 0.5, "cat2": 0.9}
_T = "CASE category WHEN 'cat1' THEN CAST(0.5 AS DOUBLE) WHEN 'cat2' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END"
LOOKUP = f"""{PAIRS}, l AS (SELECT query_id, category, entry_id, distance, model, {_T} AS threshold, distance <= {_T} AS hit FROM r WHERE rank = 1),
  k AS (SELECT *, CASE WHEN NOT hit THEN 'miss' WHEN distance >= threshold - CAST(0.05 AS DOUBLE) THEN 'uncertain' ELSE 'high' END AS confidence FROM l)"""


def lookup(t: Tables):
    return S.cache_lookup(queries(t), entries(t), 0.7, THRESHOLDS)


@query(
    "cache_lookup",
    "V2",
    f"WITH {LOOKUP} SELECT query_id, category, entry_id, round(distance, 6) AS distance, threshold, hit, confidence, CASE WHEN NOT hit THEN round(distance - threshold, 6) END AS delta_to_threshold FROM k",
)
def _lookup(t: Tables):
    return lookup(t).withColumns({"distance": F.round("distance", 6), "delta_to_threshold": F.round("delta_to_threshold", 6)})


def texts(t: Tables):
    """A text for every vector, from the documents."""
    return t.table("documents").select(F.col("doc_id").alias("vec_id"), "text")


_TOK = r"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({c}), '\s+'), lambda w: regexp_replace(w, '^[.,!?;:\"''()\[\]{{}}<>]+|[.,!?;:\"''()\[\]{{}}<>]+$', '', 'g')), lambda w: w <> ''))"
_TOKA = r"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({c}), '\s+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> ''))"
_BLEND = "CAST(0.7 AS DOUBLE)*(1-distance) + CAST({w} AS DOUBLE)*CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct))/len(qt) ELSE 0 END"


@query(
    "rerank_keyword",
    "V3",
    f"""WITH {PAIRS}, x AS (SELECT doc_id, {_TOK.format(c='text')} AS tok FROM documents),
      s AS (SELECT query_id, entry_id, distance, rank, ({_BLEND.format(w=1.0 - 0.7)}) AS score FROM (SELECT r.query_id, entry_id, distance, rank, a.tok AS qt, b.tok AS ct FROM r JOIN x a ON a.doc_id = query_id JOIN x b ON b.doc_id = entry_id WHERE rank <= 8))
    SELECT query_id, arg_min(entry_id, (-score, rank)) AS entry_id, round(max(score), 6) AS score, round(arg_min(distance, (-score, rank)), 6) AS distance, round(arg_min(distance, rank), 6) AS gate_distance FROM s GROUP BY 1""",
)
def _rerank(t: Tables):
    near = N.knn(queries(t), entries(t), 8)
    q = texts(t).select(F.col("vec_id").alias("query_id"), token_set(F.col("text")).alias("query_tokens"))
    e = texts(t).select(F.col("vec_id").alias("entry_id"), token_set(F.col("text")).alias("entry_tokens"))
    picked = S.rerank_keyword(near.join(q, "query_id").join(e, "entry_id"), "query_tokens", "entry_tokens")
    return picked.withColumns({c: F.round(c, 6) for c in ("score", "distance", "gate_distance")})


@query(
    "stale_model_hits",
    "V4",
    f"WITH {LOOKUP} SELECT query_id, entry_id, hit AND model = 'm1' AS hit, hit AND model <> 'm1' AS stale, CASE WHEN hit AND model <> 'm1' THEN 'miss' ELSE confidence END AS confidence FROM k",
)
def _stale(t: Tables):
    models = entries(t).select("entry_id", "model")
    checked, _ = S.stale_model(lookup(t).join(models, "entry_id", "left"), "m1")
    return checked.select("query_id", "entry_id", "hit", "stale", "confidence")


@query(
    "stale_model_evictions",
    "V4",
    f"WITH {LOOKUP} SELECT DISTINCT entry_id FROM k WHERE hit AND model <> 'm1'",
)
def _stale_evictions(t: Tables):
    models = entries(t).select("entry_id", "model")
    return S.stale_model(lookup(t).join(models, "entry_id", "left"), "m1")[1]


@query(
    "judged_hits",
    "V5",
    f"""WITH {LOOKUP}, v AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 3 = 0 THEN 'accept' ELSE 'reject' END AS verdict FROM v_vec WHERE vec_id % 4 <> 0),
      j AS (SELECT k.*, confidence = 'uncertain' AS u, verdict FROM k LEFT JOIN v USING (query_id))
    SELECT query_id, hit AND NOT (u AND coalesce(verdict,'error') = 'reject') AS hit, CASE WHEN u AND coalesce(verdict,'error') = 'reject' THEN 'miss' WHEN u AND verdict = 'accept' THEN 'high' ELSE confidence END AS confidence FROM j""",
)
def _judged(t: Tables):
    verdicts = t.vec.where(F.col("vec_id") % 4 != 0).select(
        F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 3 == 0, "accept").otherwise("reject").alias("verdict")
    )
    return S.apply_verdicts(lookup(t), verdicts).select("query_id", "hit", "confidence")


@query(
    "invalidated_entries",
    "V6",
    "SELECT category, count(*) AS kept FROM v_vec WHERE side = 'entry' AND NOT (model = 'm2' OR category = 'cat3') GROUP BY 1",
)
def _invalidate(t: Tables):
    left = S.invalidate(entries(t), (F.col("model") == "m2") | (F.col("category") == "cat3"))
    return left.groupBy("category").agg(F.count(F.lit(1)).alias("kept"))


_SCOPED = """s AS (SELECT id, ts_ms, unnest(['all', category]) AS scope, score, result = 'hit' AS h, cost_micros FROM v_sim), w AS (SELECT *, CASE WHEN scope = 'cat1' THEN CAST(0.28 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS t FROM s)"""


@query(
    "threshold_effectiveness",
    "V7",
    f"""WITH {_SCOPED}, g AS (SELECT scope, t, count(*) AS n, count(*) FILTER (h) AS hits, count(*) FILTER (h AND score >= t - CAST(0.05 AS DOUBLE)) AS u, count(*) FILTER (NOT h AND score > t AND score <= t + CAST(0.03 AS DOUBLE)) AS nm,
        CAST(sum(CAST(round(score*1e9) AS BIGINT)) FILTER (h) AS DOUBLE) AS hs, CAST(sum(CAST(round(score*1e9) AS BIGINT)) FILTER (NOT h) AS DOUBLE) AS ms,
        CAST(coalesce(sum(CAST(round(score*1e9) AS BIGINT) - CAST(round(t*1e9) AS BIGINT)) FILTER (NOT h AND score > t AND score <= t + CAST(0.03 AS DOUBLE)), 0) AS DOUBLE) AS ns FROM w GROUP BY 1,2),
      k AS (SELECT *, CASE WHEN hits > 0 THEN u/hits ELSE 0 END AS ur, CASE WHEN n > hits THEN nm/(n-hits) ELSE 0 END AS nr, CASE WHEN nm > 0 THEN ns/nm/CAST(1e9 AS DOUBLE) ELSE 0 END AS nd FROM g)
    SELECT scope AS category, n AS samples, t AS threshold, hits/n AS hit_rate, ur AS uncertain_hit_rate, nr AS near_miss_rate, CASE WHEN hits > 0 THEN hs/hits/CAST(1e9 AS DOUBLE) ELSE 0 END AS avg_hit_score, CASE WHEN n > hits THEN ms/(n-hits)/CAST(1e9 AS DOUBLE) ELSE 0 END AS avg_miss_score,
      CASE WHEN ur > 0.2 THEN 'tighten_threshold' WHEN nr > 0.3 AND nd < 0.03 THEN 'loosen_threshold' ELSE 'optimal' END AS recommendation,
      CASE WHEN ur > 0.2 THEN greatest(CAST(0 AS DOUBLE), t - CAST({0.05 * 1.5} AS DOUBLE)) WHEN nr > 0.3 AND nd < 0.03 THEN t + nd END AS recommended_threshold FROM k""",
)
def _effectiveness(t: Tables):
    return S.threshold_effectiveness(t.sim, 0.3, {"cat1": 0.28})


@query(
    "threshold_recommendation",
    "V8 V9",
    f"""WITH {_SCOPED}, p AS (SELECT scope, max(score) FILTER (rn = CAST(floor(hn*CAST(0.75 AS DOUBLE)) AS BIGINT)+1) AS p75 FROM (SELECT scope, score, row_number() OVER (PARTITION BY scope ORDER BY score) AS rn, count(*) OVER (PARTITION BY scope) AS hn FROM w WHERE h) GROUP BY 1),
      g AS (SELECT w.scope, t, any_value(p75) AS p75, count(*) AS n, count(*) FILTER (h) AS hits, count(*) FILTER (h AND score >= t - CAST(0.05 AS DOUBLE)) AS u, count(*) FILTER (h AND score > t/2) AS dh, count(*) FILTER (NOT h AND score > t AND score <= t + CAST(0.05 AS DOUBLE)) AS nm,
        CAST(sum(CAST(round(score*1e9) AS BIGINT) - CAST(round(t*1e9) AS BIGINT)) FILTER (NOT h AND score > t AND score <= t + CAST(0.05 AS DOUBLE)) AS DOUBLE) AS ns, max(ts_ms) AS latest FROM w JOIN p ON p.scope = w.scope GROUP BY 1,2),
      k AS (SELECT *, hits/n AS hr, CASE WHEN hits > 0 THEN u/hits ELSE 0 END AS ur, CASE WHEN hits > 0 THEN dh/hits ELSE 0 END AS dr, CASE WHEN n > hits THEN nm/(n-hits) ELSE 0 END AS nr FROM g),
      x AS (SELECT *, CASE WHEN ur > 0.2 AND ur*hr > 0.15 THEN 'uncertain_hits' WHEN ur > 0.2 THEN NULL WHEN dr > 0.25 AND hits >= 20 THEN CASE WHEN hr > 0.8 THEN 'distant_hits' END WHEN nr > 0.25 THEN 'near_misses' END AS sig FROM k)
    SELECT scope AS category, n AS samples, t AS threshold, 'optimal' AS recommendation, CAST(NULL AS DOUBLE) AS recommended_threshold, CAST(NULL AS VARCHAR) AS signal, CAST(NULL AS VARCHAR) AS blocked_by, CAST(NULL AS DOUBLE) AS signal_rate, CAST(NULL AS DOUBLE) AS confidence FROM x WHERE sig IS NULL
    UNION ALL SELECT scope, n, t, 'tighten', least(t, greatest(t - CAST(0.1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), p75 + CAST({0.05 * 0.3} AS DOUBLE)))), sig, NULL, dr, NULL FROM x WHERE sig = 'distant_hits'
    UNION ALL SELECT scope, n, t, 'loosen', t + ns/nm/CAST(1e9 AS DOUBLE), sig, NULL, nr, round(cbrt(least(CAST(1 AS DOUBLE), n/200)*least(CAST(1 AS DOUBLE), (nr-CAST(0.25 AS DOUBLE))/(CAST(0.8 AS DOUBLE)-CAST(0.25 AS DOUBLE)))*(1-(1706659200000-latest)/CAST(3600000 AS DOUBLE))), 9) FROM x WHERE sig = 'near_misses'""",
)
def _recommendation(t: Tables):
    advice = S.threshold_recommendation(t.sim, 0.3, {"cat1": 0.28}, now_ms=ORIGIN_MS + 30 * DAY)
    return advice.withColumn("confidence", F.round("confidence", 9))


@query(
    "advice_confidence",
    "V9",
    """SELECT id, CASE WHEN s*g*f > 0 THEN round(least(CAST(1 AS DOUBLE), cbrt(s*g*f)), 9) ELSE 0 END AS confidence FROM (SELECT id, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (id % 400)/200)) AS s,
      greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (score - CAST(0.2 AS DOUBLE))/(CAST(0.8 AS DOUBLE) - CAST(0.2 AS DOUBLE)))) AS g, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - (id % 5000*1000)/CAST(3600000 AS DOUBLE))) AS f FROM v_sim)""",
)
def _confidence(t: Tables):
    from fleetscope.functions.scoring import confidence

    value = confidence(F.col("id") % 400, F.col("score"), F.lit(0.2), F.col("id") % 5000 * 1000)
    return t.sim.select("id", F.round(value, 9).alias("confidence"))


_SWEEP = """c AS (SELECT threshold, count(*) FILTER (ex AND distance <= threshold) AS tp, count(*) FILTER (NOT ex AND distance <= threshold) AS fp, count(*) FILTER (NOT ex AND NOT distance <= threshold) AS tn,
    count(*) FILTER (ex AND NOT distance <= threshold) AS fn FROM {src}, (SELECT unnest([CAST(0.5 AS DOUBLE), 0.6, 0.7, 0.8, 0.9]) AS threshold) GROUP BY 1),
  m AS (SELECT *, CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 0 END AS precision, CASE WHEN tp+fn > 0 THEN tp/(tp+fn) ELSE 0 END AS recall FROM c),
  sweep AS (SELECT *, CASE WHEN precision+recall > 0 THEN CAST(2 AS DOUBLE)*precision*recall/(precision+recall) ELSE 0 END AS f1, CASE WHEN fp+tn > 0 THEN fp/(fp+tn) ELSE 0 END AS fpr, (tp+fp)/(tp+fp+tn+fn) AS hit_rate FROM m)"""
CUTS = [0.5, 0.6, 0.7, 0.8, 0.9]


def dense(t: Tables):
    return R.replay_dense(queries(t), entries(t))


_DENSE = f"{PAIRS}, n AS (SELECT query_id, label = elabel AS ex, distance FROM r WHERE rank = 1)"


@query("replay_dense_sweep", "V10 A31", f"WITH {_DENSE}, {_SWEEP.format(src='n')} SELECT * FROM sweep")
def _sweep(t: Tables):
    return R.benchmark(dense(t), CUTS)


@query(
    "best_threshold",
    "A31",
    f"WITH {_DENSE}, {_SWEEP.format(src='n')} SELECT arg_max(threshold, (f1, -threshold)) AS threshold, max(f1) AS f1 FROM sweep",
)
def _best(t: Tables):
    return S.best_threshold(R.benchmark(dense(t), CUTS))


_NEXT = f"p AS (SELECT a.vec_id AS pair_id, a.label = b.label AS ex, {_DIST.format(a='b.embedding', b='a.embedding')} AS distance FROM v_vec a JOIN v_vec b ON b.vec_id = a.vec_id + 1)"


def paired(t: Tables):
    after = t.vec.select((F.col("vec_id") - 1).alias("pair_id"), F.col("embedding").alias("embedding_b"), F.col("label").alias("_l"))
    pairs = t.vec.withColumnRenamed("vec_id", "pair_id").join(after, "pair_id").select(
        "pair_id", F.col("embedding").alias("embedding_a"), "embedding_b", (F.col("label") == F.col("_l")).alias("expected")
    )
    return R.replay_pairs(pairs)


@query("replay_paired_sweep", "V10", f"WITH {_NEXT}, {_SWEEP.format(src='p')} SELECT * FROM sweep")
def _paired(t: Tables):
    return R.benchmark(paired(t), CUTS)


@query(
    "confusion_metrics",
    "A30",
    """WITH m AS (SELECT category, count(*) FILTER (x AND h) AS tp, count(*) FILTER (NOT x AND h) AS fp, count(*) FILTER (NOT x AND NOT h) AS tn, count(*) FILTER (x AND NOT h) AS fn FROM (SELECT category, id % 3 = 0 AS x, result = 'hit' AS h FROM v_sim) GROUP BY 1),
      p AS (SELECT *, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall FROM m) SELECT *, CAST(2 AS DOUBLE)*precision*recall/(precision+recall) AS f1, fp/(fp+tn) AS fpr, (tp+fp)/(tp+fp+tn+fn) AS hit_rate FROM p""",
)
def _confusion(t: Tables):
    rows = t.sim.select("category", (F.col("id") % 3 == 0).alias("expected"), (F.col("result") == "hit").alias("hit"))
    return S.confusion_metrics(rows, ["category"])


@query(
    "replay_latency",
    "A30",
    "SELECT category, count(*) AS n, quantile_cont(CAST(cost_micros AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(cost_micros AS DOUBLE), 0.95) AS p95, quantile_cont(CAST(cost_micros AS DOUBLE), 0.99) AS p99 FROM v_sim WHERE cost_micros IS NOT NULL GROUP BY 1",
)
def _latency(t: Tables):
    return S.latency_summary(t.sim.withColumnRenamed("cost_micros", "latency"), ["category"])


@query(
    "recent_similarity_window",
    "T23",
    f"SELECT id, ts_ms, score FROM v_sim WHERE ts_ms > {ORIGIN_MS + 23 * DAY} ORDER BY ts_ms DESC, id DESC LIMIT 1500",
)
def _window(t: Tables):
    return S.recent_samples(t.sim, ORIGIN_MS + 30 * DAY, 7, 1500).select("id", "ts_ms", "score")


def recall_inputs(t: Tables):
    asked = t.mem.where(F.col("item_id") % 5 == 0).select(F.col("item_id").alias("query_id"), "embedding", "thread_id")
    return asked, t.mem


RECALL = f"""q AS (SELECT item_id AS query_id, embedding, thread_id FROM v_mem WHERE item_id % 5 = 0),
  d AS (SELECT query_id, item_id AS entry_id, importance, greatest(created_ms, accessed_ms) AS touched, round({_DIST.format(a='q.embedding', b='m.embedding')}, 12) AS distance FROM q JOIN v_mem m ON m.thread_id = q.thread_id),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, entry_id) AS rn FROM d) WHERE rn <= 16),
  s AS (SELECT query_id, entry_id, distance, round(0.6::DOUBLE*(1-distance/2) + 0.25::DOUBLE*exp(-ln(2)*(({NOW} - touched)/1000)/604800) + 0.15::DOUBLE*importance, 15) AS score FROM f WHERE distance <= 0.9),
  h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS position FROM s)"""


@query("memory_recall", "V11", f"WITH {RECALL} SELECT query_id, entry_id, round(distance, 6) AS distance, round(score, 6) AS score, position FROM h WHERE position <= 4")
def _recall(t: Tables):
    asked, memories = recall_inputs(t)
    near = M.recall_candidates(asked, memories, 4, match_on=["thread_id"])
    hits = M.score_candidates(near, memories, NOW, 4, 0.9, HALF_LIFE)
    return hits.withColumns({"distance": F.round("distance", 6), "score": F.round("score", 6)})


@query(
    "recall_near_misses",
    "V12",
    f"WITH {PAIRS} SELECT query_id, round(min(distance), 6) AS nearest FROM d GROUP BY 1 HAVING min(distance) > 0.4 AND min(distance) <= 0.8",
)
def _near(t: Tables):
    near = N.knn(queries(t), entries(t), 32)
    return M.near_miss_report(near, queries(t), 0.4).select("query_id", F.round("nearest", 6).alias("nearest"))


@query(
    "reinforced_memories",
    "V13",
    f"""WITH {RECALL}, n AS (SELECT entry_id, count(*) AS c FROM h WHERE position <= 4 GROUP BY 1) SELECT item_id, CASE WHEN c IS NOT NULL THEN {NOW} ELSE accessed_ms END AS accessed_ms, coalesce(c, 0) AS access_count FROM v_mem LEFT JOIN n ON entry_id = item_id""",
)
def _reinforce(t: Tables):
    asked, memories = recall_inputs(t)
    near = M.recall_candidates(asked, memories, 4, match_on=["thread_id"])
    hits = M.score_candidates(near, memories, NOW, 4, 0.9, HALF_LIFE)
    counted = memories.withColumn("access_count", F.lit(0).cast("bigint"))
    return M.reinforce(counted, hits, NOW).select("item_id", "accessed_ms", "access_count")


EVICT = f"""e AS (SELECT thread_id, item_id, row_number() OVER (PARTITION BY thread_id ORDER BY (0.15::DOUBLE*importance + 0.25::DOUBLE*exp(-ln(2)*(({NOW} - accessed_ms)/1000)/31536000))/({0.15 + 0.25}::DOUBLE), accessed_ms, item_id) AS rn,
  count(*) OVER (PARTITION BY thread_id) AS n FROM v_mem)"""


@query("memory_evictions", "V14", f"WITH {EVICT} SELECT thread_id, item_id FROM e WHERE rn <= n - 20")
def _evictions(t: Tables):
    return M.evictions(t.mem, 20, NOW, 31_536_000.0).select("thread_id", "item_id")


@query("memory_stats", "A44", f"WITH {EVICT} SELECT thread_id, count(*) AS items, count(*) FILTER (rn <= n - 20) AS evictions FROM e GROUP BY 1")
def _memory_stats(t: Tables):
    return M.memory_stats(t.mem, M.evictions(t.mem, 20, NOW, 31_536_000.0))


@query(
    "memory_page",
    "A44",
    "SELECT item_id, created_ms, (SELECT count(*) FROM v_mem WHERE thread_id = 't1') AS total FROM v_mem WHERE thread_id = 't1' ORDER BY created_ms DESC, item_id LIMIT 10 OFFSET 5",
)
def _page(t: Tables):
    return M.memory_list(t.mem, 10, 5, M.scope_filter(thread_id="t1")).select("item_id", "created_ms", "total")


@query("forgotten_scope", "V17", "SELECT thread_id, count(*) AS n FROM v_mem WHERE thread_id <> 't2' GROUP BY 1")
def _forget(t: Tables):
    return M.forget_by_scope(t.mem, M.scope_filter(thread_id="t2")).groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "knn_graph",
    "V24",
    f"""WITH d AS (SELECT a.vec_id AS x, b.vec_id AS y, round({_DIST.format(a='a.embedding', b='b.embedding')}, 12) AS dist FROM v_vec a JOIN v_vec b ON a.vec_id <> b.vec_id),
      k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY dist, y) AS rn FROM d) WHERE rn <= 3)
    SELECT least(x, y) AS a, greatest(x, y) AS b, round(min(dist), 6) AS distance FROM k GROUP BY 1, 2""",
)
def _graph(t: Tables):
    items = t.vec.select(F.col("vec_id").alias("item_id"), "embedding")
    return N.knn_graph(items, 3).select("a", "b", _R9())


@query(
    "knn_graph_degree",
    "V24",
    f"""WITH d AS (SELECT a.vec_id AS x, b.vec_id AS y, round({_DIST.format(a='a.embedding', b='b.embedding')}, 12) AS dist FROM v_vec a JOIN v_vec b ON a.vec_id <> b.vec_id),
      k AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY dist, y) AS rn FROM d) WHERE rn <= 3)
    SELECT item_id, count(*) AS degree FROM (SELECT a AS item_id FROM k UNION ALL SELECT b FROM k) GROUP BY 1""",
)
def _degree(t: Tables):
    items = t.vec.select(F.col("vec_id").alias("item_id"), "embedding")
    return N.graph_degree(N.knn_graph(items, 3))


@query(
    "embedded_documents",
    "V25",
    "SELECT doc_id, CAST(length(text) AS DOUBLE) AS first_value, (SELECT count(*) FROM documents d2 WHERE d2.text = d.text) AS copies FROM documents d",
)
def _embed(t: Tables):
    docs = t.table("documents").select("doc_id", "text")
    vectors = N.embed_distinct(docs, "text", lambda text: F.array(F.length(text).cast("float")))
    copies = docs.groupBy(F.sha2("text", 256).alias("_d")).agg(F.count(F.lit(1)).alias("copies"))
    return vectors.withColumn("_d", F.sha2("text", 256)).join(copies, "_d").select(
        "doc_id", F.col("embedding")[0].cast("double").alias("first_value"), "copies"
    )


@query("chunked_sessions", "V18", walks.CHUNKS)
def _chunks(t: Tables):
    return M.chunk_sessions(t.session, 40)


@query(
    "chunked_turns",
    "V18",
    r"""WITH w AS (SELECT session_id, turn, line, regexp_split_to_array(trim(line, E' \t\n\r'), '\s+') AS w FROM v_session)
    SELECT session_id, turn, CAST(g.range AS BIGINT) AS part, CASE WHEN len(w) <= 40 THEN line ELSE array_to_string(list_slice(w, CAST(g.range AS BIGINT)*40+1, CAST(g.range AS BIGINT)*40+40), ' ') END AS text
    FROM w, range(1000) g WHERE g.range = 0 OR (len(w) > 40 AND g.range*40 < len(w))""",
)
def _turns(t: Tables):
    return M.chunk_turns(t.session, 40)


def questions_and_chunks(t: Tables):
    """Queries with the text of a document; entries as chunks of sessions with a day."""
    q = queries(t).join(texts(t).withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "embedding", "text", "label")
    e = entries(t).join(texts(t).withColumnRenamed("vec_id", "entry_id"), "entry_id").select(
        "entry_id", "embedding", "text", (F.col("entry_id") % 40).alias("session_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("entry_id") % 365).cast("int")).alias("day"), "label",
    )
    return q, e


# Only vectors that have a document take part, on both sides.
_TEXTED = PAIRS.replace("side = 'query'", "side = 'query' AND vec_id IN (SELECT doc_id FROM documents)").replace(
    "side = 'entry'", "side = 'entry' AND vec_id IN (SELECT doc_id FROM documents)"
)
POOL = f"""{_TEXTED}, x AS (SELECT doc_id, {_TOKA.format(c='text')} AS tok FROM documents),
  b AS (SELECT query_id, entry_id, label, elabel, distance, rank, entry_id % 40 AS session_id, DATE '2024-01-01' + CAST(entry_id % 365 AS INTEGER) AS day, ({_BLEND.format(w=1.0 - 0.7)}) AS score
    FROM (SELECT r.*, a.tok AS qt, c.tok AS ct FROM r JOIN x a ON a.doc_id = query_id JOIN x c ON c.doc_id = entry_id WHERE rank <= 12)),
  p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS position FROM b)"""


def pool(t: Tables):
    q, e = questions_and_chunks(t)
    return R.rerank_pool(q, e, 12)


@query("hybrid_rerank", "V19", f"WITH {POOL} SELECT query_id, entry_id, round(score, 6) AS score, position FROM p")
def _hybrid(t: Tables):
    return pool(t).select("query_id", "entry_id", F.round("score", 6).alias("score"), "position")


@query(
    "recall_at_k",
    "A32 V26",
    f"""WITH {POOL}, ev AS (SELECT DISTINCT q.query_id, e.entry_id % 40 AS session_id FROM q JOIN e ON e.label = q.label), hit AS (SELECT DISTINCT p.query_id FROM p JOIN ev ON ev.query_id = p.query_id AND ev.session_id = p.session_id WHERE position <= 3),
      z AS (SELECT q.query_id, concat('type', q.query_id % 4) AS question_type, hit.query_id IS NOT NULL AS h FROM q LEFT JOIN hit USING (query_id))
    SELECT question_type, count(*) AS questions, count(*) FILTER (h) AS recalled, count(*) FILTER (h)/count(*) AS recall FROM z GROUP BY 1 UNION ALL SELECT '(all)', count(*), count(*) FILTER (h), count(*) FILTER (h)/count(*) FROM z""",
)
def _recall_at_k(t: Tables):
    q, e = questions_and_chunks(t)
    per_label = e.select("label", "session_id").distinct()
    evidence = q.select("query_id", "label").join(per_label, "label").select("query_id", "session_id")
    kinds = q.select("query_id", F.concat(F.lit("type"), (F.col("query_id") % 4).cast("string")).alias("question_type"))
    return S.recall_at_k(pool(t).select("query_id", "position", "session_id"), evidence, kinds, 3)


def asked_days(t: Tables):
    return queries(t).select("query_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("query_id") % 200).cast("int")).alias("asked_day"))


_ASKED = "k AS (SELECT *, DATE '2024-01-01' + CAST(query_id % 200 AS INTEGER) AS asked_day FROM p), o AS (SELECT * FROM (SELECT *, bool_or(day <= asked_day) OVER (PARTITION BY query_id) AS a FROM k) WHERE day <= asked_day OR NOT a)"


@query("hits_as_of", "V20", f"WITH {POOL}, {_ASKED} SELECT query_id, entry_id, position FROM o")
def _as_of(t: Tables):
    return M.as_of(pool(t).join(asked_days(t), "query_id")).select("query_id", "entry_id", "position")


@query(
    "chronological_hits",
    "V23",
    f"""WITH {POOL} SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY f, l, day, position) AS reading_order FROM (SELECT *, min(day) OVER (PARTITION BY query_id, session_id) AS f, min(position) OVER (PARTITION BY query_id, session_id) AS l FROM p)""",
)
def _chronological(t: Tables):
    return M.group_chronologically(pool(t)).select("query_id", "entry_id", "reading_order")


# Pool rows with their tokens, and the containment of each pair of one pool.
_CONT = """c AS (SELECT p.query_id, p.entry_id, p.position, t.tok FROM p JOIN x t ON t.doc_id = p.entry_id),
  y AS MATERIALIZED (SELECT a.query_id, a.position AS a, b.position AS b, CASE WHEN least(len(a.tok), len(b.tok)) > 0 THEN len(list_intersect(a.tok, b.tok))/least(len(a.tok), len(b.tok)) ELSE 0 END AS ct
    FROM c a JOIN c b ON b.query_id = a.query_id),
  z AS MATERIALIZED (SELECT query_id, a AS position, list(ct ORDER BY b) AS sims FROM y GROUP BY 1, 2)"""
_KEPT = """k AS (SELECT query_id, CAST(0 AS BIGINT) AS position, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT query_id FROM z)
  UNION ALL SELECT z.query_id, z.position, CASE WHEN len(list_filter(k.kept, lambda j: z.sims[j] >= {t})) = 0 THEN list_append(k.kept, z.position) ELSE k.kept END FROM k JOIN z ON z.query_id = k.query_id AND z.position = k.position + 1),
  f AS (SELECT query_id, unnest(kept) AS position, unnest(range(1, len(kept) + 1)) AS picked FROM (SELECT query_id, arg_max(kept, position) AS kept FROM k GROUP BY 1))"""


@query(
    "deduped_hits",
    "V21",
    f"""WITH RECURSIVE {POOL}, {_CONT}, {_KEPT.format(t="CAST(0.5 AS DOUBLE)")}
    SELECT f.query_id, p.entry_id, f.position, f.picked FROM f JOIN p ON p.query_id = f.query_id AND p.position = f.position""",
)
def _deduped(t: Tables):
    hits = pool(t).select("query_id", "entry_id", "position", F.col("chunk_text").alias("text"))
    return M.dedupe_containment(hits, 0.5)


@query(
    "mmr_hits",
    "V22",
    f"""WITH RECURSIVE {POOL}, {_CONT}, g AS (SELECT query_id, count(*) AS n FROM z GROUP BY 1),
      k AS (SELECT query_id, CAST(0 AS BIGINT) AS s, CAST([] AS BIGINT[]) AS ch FROM g
        UNION ALL SELECT w.query_id, w.s + 1, list_append(any_value(w.ch), arg_max(w.position, (w.score, -w.position))) FROM
          (SELECT k.query_id, k.s, k.ch, z.position, CAST(0.7 AS DOUBLE)*(1 - (z.position - 1)/g.n) - CAST({1 - 0.7!r} AS DOUBLE)*coalesce(list_max(list_transform(k.ch, lambda j: z.sims[j])), 0) AS score
           FROM k JOIN z ON z.query_id = k.query_id JOIN g ON g.query_id = k.query_id WHERE k.s < 5 AND NOT list_contains(k.ch, z.position)) w GROUP BY w.query_id, w.s),
      f AS (SELECT query_id, unnest(ch) AS position, unnest(range(1, len(ch) + 1)) AS picked FROM (SELECT query_id, arg_max(ch, s) AS ch FROM k GROUP BY 1))
    SELECT f.query_id, p.entry_id, f.position, f.picked FROM f JOIN p ON p.query_id = f.query_id AND p.position = f.position""",
)
def _mmr(t: Tables):
    hits = pool(t).select("query_id", "entry_id", "position", F.col("chunk_text").alias("text"))
    return M.mmr(hits, 5, 0.7)


@query(
    "reading_contexts",
    "V26",
    f"""WITH RECURSIVE {POOL.replace("p AS (SELECT *, row_number()", "p0 AS (SELECT *, row_number()")},
      {_ASKED.replace("FROM p)", "FROM p0)")}, p AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY position) AS position) FROM o),
      {_CONT}, {_KEPT.format(t="CAST(0.9 AS DOUBLE)").replace("k AS (SELECT query_id, CAST(0", "kk AS (SELECT query_id, CAST(0").replace("k.", "kk.").replace("FROM k ", "FROM kk ")},
      h AS (SELECT f.query_id, p.entry_id, p.session_id, p.day, f.picked FROM f JOIN p ON p.query_id = f.query_id AND p.position = f.position WHERE f.picked <= 5),
      m AS (SELECT *, min(day) OVER (PARTITION BY query_id, session_id) AS fd, min(picked) OVER (PARTITION BY query_id, session_id) AS fp FROM h)
    SELECT m.query_id, row_number() OVER (PARTITION BY m.query_id ORDER BY fd, fp, day, picked) AS reading_order, m.entry_id, concat('[', CAST(day AS VARCHAR), '] ', d.text) AS context FROM m JOIN documents d ON d.doc_id = m.entry_id""",
)
def _contexts(t: Tables):
    return R.reading_contexts(pool(t), asked_days(t), 5)


@query(
    "consolidation_plan",
    "V16",
    """WITH st AS (SELECT event_id AS id, concat('s', user_id % 4) AS scope, lower(trim(concat(' Topic ', user_id, ' '))) AS subject, event_type AS statement FROM events),
      cu AS (SELECT DISTINCT concat('s', c_custkey % 4) AS scope, concat('topic ', c_custkey % 300) AS subject, CASE WHEN c_custkey % 300 % 5 = 0 THEN 'click' ELSE 'view' END AS statement FROM customer),
      h AS (SELECT scope, subject, min(id) AS id, arg_min(statement, id) AS stored FROM st GROUP BY 1,2)
    SELECT * FROM (SELECT CASE WHEN id IS NULL THEN 'create' WHEN statement IS NULL THEN 'delete' WHEN statement <> stored THEN 'rewrite' END AS action, scope, subject, id, statement FROM h FULL JOIN cu USING (scope, subject)) WHERE action IS NOT NULL
    UNION ALL SELECT 'delete', st.scope, st.subject, st.id, NULL FROM st JOIN h ON h.scope = st.scope AND h.subject = st.subject WHERE st.id <> h.id""",
)
def _consolidation(t: Tables):
    stored = t.events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("scope"),
        F.concat(F.lit(" Topic "), F.col("user_id").cast("string"), F.lit(" ")).alias("subject"),
        F.col("event_type").alias("statement"),
    )
    key = F.col("c_custkey")
    curated = t.table("customer").select(
        F.concat(F.lit("s"), (key % 4).cast("string")).alias("scope"),
        F.concat(F.lit("Topic "), (key % 300).cast("string")).alias("subject"),
        F.when(key % 300 % 5 == 0, "click").otherwise("view").alias("statement"),
    ).distinct()
    return M.consolidation_plan(stored, curated)


@query(
    "consolidation_candidates",
    "V16",
    f"SELECT item_id FROM v_mem WHERE created_ms <= {ORIGIN_MS + 20 * DAY} AND importance <= 0.5 AND thread_id = 't3' AND item_id % 7 <> 0",
)
def _candidates(t: Tables):
    tagged = t.mem.withColumn("source", F.when(F.col("item_id") % 7 == 0, "consolidated"))
    return M.consolidation_candidates(
        tagged, ORIGIN_MS + 50 * DAY, 30 * DAY, 0.5, M.scope_filter(thread_id="t3")
    ).select("item_id")
