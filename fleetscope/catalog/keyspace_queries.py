"""Keyspace queries."""

from pyspark.sql import functions as F

from fleetscope.catalog.registry import query
from fleetscope.catalog.views import Tables
from fleetscope.operators import keyspace as K

_PAT = """array_to_string(list_transform(regexp_split_to_array(key, '[:._-]'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+')
  OR regexp_full_match(x, '[0-9a-fA-F]{24}') OR regexp_full_match(x, '[0-9a-fA-F]{32,}') THEN '*' ELSE x END), ':')"""


@query(
    "key_pattern_snapshot",
    "A14 P2",
    f"""WITH k AS (SELECT *, {_PAT} AS pattern FROM v_key), a AS (SELECT connection_id, pattern, avg(freq) AS af FROM k GROUP BY 1,2),
      s AS (SELECT k.connection_id, k.pattern, count(*) AS c, sum(memory_bytes) AS mem, max(memory_bytes) AS mm, sum(idle_s) AS idle, count(*) FILTER (ttl_s>0) AS tn,
        sum(ttl_s) FILTER (ttl_s>0) AS ts, min(ttl_s) FILTER (ttl_s>0) AS tmin, max(ttl_s) FILTER (ttl_s>0) AS tmax, count(*) FILTER (ttl_s>0 AND ttl_s<3600) AS soon,
        max(af) AS af, count(*) FILTER (freq > af) AS hot, count(*) FILTER (freq < af/2) AS cold FROM k JOIN a USING (connection_id, pattern) GROUP BY 1,2)
    SELECT connection_id, pattern, CAST(floor(c/0.5::DOUBLE+0.5) AS BIGINT) AS key_count, c AS sampled, CAST(floor(tn/0.5::DOUBLE+0.5) AS BIGINT) AS keys_with_ttl,
      CAST(floor(soon/0.5::DOUBLE+0.5) AS BIGINT) AS keys_expiring_soon, CAST(floor(mem/0.5::DOUBLE+0.5) AS BIGINT) AS total_memory,
      CAST(floor(mem/c+0.5) AS BIGINT) AS avg_memory, mm AS max_memory, af AS avg_freq, hot AS hot_keys, cold AS cold_keys, CAST(floor(idle/c+0.5) AS BIGINT) AS avg_idle_s,
      CASE WHEN floor(idle/c+0.5) > 86400 THEN CAST(floor(floor(idle/c+0.5)/86400*c+0.5) AS BIGINT) ELSE 0 END AS stale_keys,
      CAST(floor(ts/tn+0.5) AS BIGINT) AS avg_ttl_s, tmin AS min_ttl, tmax AS max_ttl FROM s""",
)
def _snapshot(t: Tables):
    scanned = t.key.groupBy("connection_id").agg(F.count(F.lit(1)).alias("scanned"))
    return K.key_pattern_snapshot(t.key, scanned.withColumn("db_size", F.col("scanned") * 2))


@query(
    "key_summary",
    "A15 J23",
    """WITH s AS (SELECT connection_id, key_type AS pattern, order_key % 30 AS ts, order_key*10+line_number AS id, cardinality AS kc, memory_bytes AS m, idle_s AS st FROM v_key),
      l AS (SELECT connection_id, pattern, arg_max(struct_pack(kc := kc, m := m, st := st), (ts, id, kc, m)) AS s FROM s GROUP BY 1,2)
    SELECT connection_id, coalesce(pattern, '(all)') AS pattern, CAST(sum(s.kc) AS BIGINT) AS key_count, CAST(sum(s.m) AS BIGINT) AS memory, CAST(sum(s.st) AS BIGINT) AS stale,
      count(*) AS patterns FROM l GROUP BY GROUPING SETS ((connection_id, pattern), (connection_id))""",
)
def _summary(t: Tables):
    snapshots = t.key.select(
        "connection_id",
        F.col("key_type").alias("pattern"),
        (F.col("order_key") % 30).alias("ts_ms"),
        F.struct(
            (F.col("order_key") * 10 + F.col("line_number")).alias("n"), "cardinality", "memory_bytes"
        ).alias("id"),
        F.col("cardinality").alias("key_count"),
        F.col("memory_bytes").alias("memory"),
        F.col("idle_s").alias("stale"),
    )
    return K.key_summary(snapshots)


@query(
    "ttl_distribution",
    "A16",
    """SELECT connection_id, count(*) FILTER (ttl_s=-1) AS no_expiry, count(*) FILTER (ttl_s>=0 AND ttl_s<3600) AS within_1h,
    count(*) FILTER (ttl_s>=3600 AND ttl_s<86400) AS within_24h, count(*) FILTER (ttl_s>=86400 AND ttl_s<604800) AS within_7d,
    count(*) FILTER (ttl_s>=604800) AS later FROM v_key GROUP BY 1""",
)
def _ttl(t: Tables):
    return K.ttl_distribution(t.key)


_COUNTS = """c AS (SELECT connection_id, count(*) AS s, count(*) FILTER (idle_s < 90000) AS t FROM v_key GROUP BY 1)"""


@query(
    "key_count_comparison",
    "A17",
    f"""WITH {_COUNTS} SELECT connection_id, s AS source_keys, t AS target_keys, t-s AS discrepancy, floor(abs((t-s)/s)*100*100+0.5)/100 AS discrepancy_pct,
    false AS stale_target FROM c""",
)
def _counts(t: Tables):
    return K.key_count_comparison(t.key, t.key.where(F.col("idle_s") < 90_000))


@query(
    "key_type_estimates",
    "A17",
    f"""WITH {_COUNTS} SELECT k.connection_id, key_type, count(*) AS source_estimate, CAST(floor(count(*)*(any_value(t)/any_value(s))+0.5) AS BIGINT) AS target_estimate
    FROM v_key k JOIN c USING (connection_id) GROUP BY 1,2""",
)
def _types(t: Tables):
    totals = K.key_count_comparison(t.key, t.key.where(F.col("idle_s") < 90_000))
    return K.type_estimates(t.key, totals)


@query(
    "field_expiry_estimate",
    "A18",
    """SELECT connection_id, count(*) AS sampled_hashes, CAST(0 AS BIGINT) AS oversized_skipped,
    count(*) FILTER (e) > 0 AS detected, CAST(floor(count(*) FILTER (e)/count(*)*any_value(tot)+0.5) AS BIGINT) AS estimated_keys
    FROM (SELECT connection_id, cardinality*400 AS f, ttl_s > 400000 AS e, order_key, count(*) OVER (PARTITION BY connection_id) AS tot FROM v_key WHERE key_type='hash') GROUP BY 1""",
)
def _hfe(t: Tables):
    hashes = t.key.where(F.col("key_type") == "hash")
    sampled = hashes.select(
        "connection_id", (F.col("cardinality") * 400).alias("fields"), (F.col("ttl_s") > 400_000).alias("has_field_ttl")
    )
    return K.field_expiry_estimate(sampled, hashes.groupBy("connection_id").agg(F.count(F.lit(1)).alias("total_hashes")))


_HOT = """SELECT connection_id, row_number() OVER (PARTITION BY connection_id ORDER BY freq IS NULL, freq DESC, idle_s, key) AS rank, key,
  CASE WHEN freq IS NOT NULL THEN 'lfu' ELSE 'idletime' END AS signal, freq, CASE WHEN freq IS NULL THEN idle_s END AS idle_s, memory_bytes FROM v_key"""


@query("hot_keys", "W6", f"SELECT * FROM ({_HOT}) WHERE rank <= 50")
def _hot(t: Tables):
    return K.hot_keys(t.key)


@query(
    "largest_keys",
    "W7",
    """SELECT * FROM (SELECT connection_id, row_number() OVER (PARTITION BY connection_id ORDER BY cardinality DESC, key) AS rank, key, key_type, cardinality, memory_bytes
    FROM v_key) WHERE rank <= 50""",
)
def _largest(t: Tables):
    # keys can repeat in the samples; the memory of equal keys breaks the tie
    return K.largest_keys(t.key)


@query(
    "largest_keys_by_memory",
    "W7",
    """SELECT * FROM (SELECT connection_id, key, memory_bytes, row_number() OVER (PARTITION BY connection_id ORDER BY memory_bytes DESC, key) AS rank
    FROM (SELECT connection_id, key, max(memory_bytes) AS memory_bytes FROM v_key GROUP BY 1,2)) WHERE rank <= 50""",
)
def _largest_memory(t: Tables):
    return K.largest_by_memory(t.key)


@query(
    "composite_keys",
    "W8",
    """WITH h AS (SELECT connection_id, key, CASE WHEN freq IS NOT NULL THEN CAST(freq AS DOUBLE) ELSE CAST(1 AS DOUBLE)/(1+idle_s) END AS v FROM v_key),
      a AS (SELECT *, max(v) OVER (PARTITION BY connection_id) AS m, row_number() OVER (PARTITION BY connection_id ORDER BY v DESC, key) AS rn FROM h WHERE v > 0),
      b AS (SELECT connection_id, key, CAST(cardinality AS DOUBLE) AS v, CAST(max(cardinality) OVER (PARTITION BY connection_id) AS DOUBLE) AS m,
        row_number() OVER (PARTITION BY connection_id ORDER BY cardinality DESC, key) AS rn FROM v_key)
    SELECT a.connection_id, a.key, a.v AS hotness, b.v AS size, a.v/a.m + b.v/b.m AS score FROM a JOIN b USING (connection_id, key) WHERE a.rn <= 500 AND b.rn <= 500""",
)
def _composite(t: Tables):
    return K.composite_keys(t.key, 500)


_RANKS = """r AS (SELECT connection_id, d AS captured_ms, key, row_number() OVER (PARTITION BY connection_id, d ORDER BY n DESC, key) AS rank
  FROM (SELECT connection_id, ts_ms//86400000 AS d, key, count(*) AS n FROM v_log GROUP BY 1,2,3)),
  q AS (SELECT * FROM r WHERE rank <= 20)"""


@query(
    "hot_key_rank_movement",
    "W9",
    f"""WITH {_RANKS}, e AS (SELECT connection_id, min(captured_ms) AS a, max(captured_ms) AS b FROM q GROUP BY 1),
      f AS (SELECT q.connection_id, key, rank FROM q JOIN e ON q.connection_id = e.connection_id AND captured_ms = a),
      l AS (SELECT q.connection_id, key, rank FROM q JOIN e ON q.connection_id = e.connection_id AND captured_ms = b)
    SELECT l.connection_id, l.key, l.rank, f.rank - l.rank AS moved_up, CASE WHEN f.rank IS NULL THEN 'new' WHEN f.rank > l.rank THEN 'up'
      WHEN f.rank < l.rank THEN 'down' ELSE 'same' END AS movement FROM l LEFT JOIN f ON l.connection_id = f.connection_id AND l.key = f.key""",
)
def _movement(t: Tables):
    from pyspark.sql import Window

    per = t.log.groupBy("connection_id", F.floor(F.col("ts_ms") / 86_400_000).alias("captured_ms"), "key").agg(
        F.count(F.lit(1)).alias("n")
    )
    rank = F.row_number().over(Window.partitionBy("connection_id", "captured_ms").orderBy(F.desc("n"), "key"))
    ranks = per.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= 20).drop("n")
    return K.rank_movement(ranks)


@query(
    "pattern_delete_preview",
    "A40",
    """SELECT connection_id, count(*) AS matched, CAST(sum(memory_bytes) AS BIGINT) AS memory_bytes, min(key) AS first_key, count(*) > 100 AS truncated FROM v_key
    WHERE regexp_full_match(key, 'part:1.*:.2.*') AND key_type = 'hash' GROUP BY 1""",
)
def _preview(t: Tables):
    return K.pattern_delete_preview(t.key, "part:1*:?2*", "hash", max_keys=100)


@query(
    "pattern_delete_apply",
    "A40",
    "SELECT connection_id, count(*) AS kept FROM v_key WHERE NOT starts_with(key, 'part:1') GROUP BY 1",
)
def _delete(t: Tables):
    return K.delete_matching(t.key, "part:1*").groupBy("connection_id").agg(F.count(F.lit(1)).alias("kept"))


def slots(t: Tables):
    return t.key.groupBy((F.col("order_key") % 16384).alias("slot")).agg(
        F.sum(F.when(F.col("cardinality") > 5, 1).otherwise(0)).alias("key_count")
    )


_SLOTS = "s AS (SELECT order_key % 16384 AS slot, count(*) FILTER (cardinality > 5) AS key_count FROM v_key GROUP BY 1)"


@query(
    "slot_summary",
    "A34",
    f"""WITH {_SLOTS} SELECT CAST(sum(key_count) AS BIGINT) AS total_keys, count(*) FILTER (key_count > 0) AS populated,
    CAST(sum(key_count) AS DOUBLE)/greatest(count(*) FILTER (key_count > 0), 1) AS avg_keys FROM s""",
)
def _slots(t: Tables):
    return K.slot_summary(slots(t))


@query(
    "slot_intensity",
    "A34",
    f"""WITH {_SLOTS} SELECT slot, key_count, CAST(0.1 AS DOUBLE) + key_count/(SELECT max(key_count) FROM s)*CAST(0.9 AS DOUBLE) AS intensity FROM s WHERE key_count > 0""",
)
def _intensity(t: Tables):
    return K.slot_intensity(slots(t))


@query(
    "tag_distribution",
    "A23",
    """SELECT value, count(*) AS n FROM (SELECT trim(unnest(string_split(concat(lang, ', ', source), ','))) AS value FROM documents) WHERE value <> '' GROUP BY 1
    ORDER BY n DESC, value LIMIT 50""",
)
def _tags(t: Tables):
    docs = t.table("documents").select(F.concat_ws(", ", "lang", "source").alias("tags"))
    return K.field_distribution(docs, "tags", "TAG")


@query(
    "numeric_distribution",
    "A23",
    """SELECT CAST(min(n_chars) AS DOUBLE) AS min_value, CAST(max(n_chars) AS DOUBLE) AS max_value, avg(n_chars) AS avg_value, count(n_chars) AS n FROM documents""",
)
def _numbers(t: Tables):
    return K.field_distribution(t.table("documents"), "n_chars", "NUMERIC")


@query(
    "text_distribution",
    "A23",
    """SELECT CASE WHEN length(value) > 60 THEN concat(left(value, 57), '...') ELSE value END AS value, n FROM
    (SELECT text AS value, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1
    ORDER BY n DESC, value LIMIT 50)""",
)
def _texts(t: Tables):
    return K.field_distribution(t.table("documents"), "text", "TEXT")
