"""Counter, gauge and state series per connection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.operators.quantiles import Quantile, exact_quantiles
from fleetscope.operators.series import (
    DAY_MS,
    HOUR_MS,
    with_previous,
    with_row_index,
    with_trailing_sums,
)

# Rolling baseline size and readiness.
BASELINE_ROWS = 300
BASELINE_READY = 30


def latest_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """Newest ``n`` rows of each group; the bound is applied before the shuffle as well."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def previous_poll(samples: DataFrame, keys: Sequence[str] = ("connection_id",)) -> DataFrame:
    """(keys, captured_ms, prev_ms): each poll of a connection with the poll before it."""
    polls = samples.select(*keys, "captured_ms").distinct()
    return with_previous(polls, list(keys), ["captured_ms"], {"prev_ms": "captured_ms"}, DAY_MS)


def counter_deltas(samples: DataFrame) -> DataFrame:
    """Per-command deltas between consecutive polls.

    A command counts only if the poll right before also had it; one negative delta
    drops the whole poll of that connection, and rows without change are dropped.
    ``samples`` has (connection_id, captured_ms, command, calls, usec).
    """
    polls = previous_poll(samples).where(F.col("prev_ms").isNotNull())
    before = samples.select(
        "connection_id",
        F.col("captured_ms").alias("prev_ms"),
        "command",
        F.col("calls").alias("_calls"),
        F.col("usec").alias("_usec"),
    )
    joined = (
        samples.join(polls, ["connection_id", "captured_ms"])
        .join(before, ["connection_id", "prev_ms", "command"])
        .withColumn("calls_delta", F.col("calls") - F.col("_calls"))
        .withColumn("usec_delta", F.col("usec") - F.col("_usec"))
    )
    # One poll holds a handful of commands, so this window is small for every key.
    poll = Window.partitionBy("connection_id", "captured_ms")
    reset = F.max((F.col("calls_delta") < 0) | (F.col("usec_delta") < 0)).over(poll)
    return (
        joined.withColumn("_reset", reset)
        .where(~F.col("_reset") & ((F.col("calls_delta") != 0) | (F.col("usec_delta") != 0)))
        .select(
            "connection_id",
            "captured_ms",
            "command",
            "calls_delta",
            "usec_delta",
            (F.col("captured_ms") - F.col("prev_ms")).alias("interval_ms"),
        )
    )


def delta_rates(deltas: DataFrame) -> DataFrame:
    """Operations per second and mean latency of each delta row."""
    interval, calls = F.col("interval_ms"), F.col("calls_delta")
    return deltas.withColumns(
        {
            "ops_per_sec": F.when(interval > 0, calls / (interval / 1000.0)).otherwise(F.lit(0.0)),
            "avg_usec": F.when(calls > 0, F.col("usec_delta") / calls).otherwise(F.lit(0.0)),
        }
    )


def clamped_deltas(df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str) -> DataFrame:
    """Growth since the row before, never negative, zero on the first row."""
    seen = with_previous(df, keys, order, {"_before": counter}, DAY_MS)
    growth = F.greatest(F.lit(0), F.col(counter) - F.coalesce("_before", counter))
    return seen.withColumn("delta", growth.cast("bigint")).drop("_before")


def cpu_utilization(df: DataFrame) -> DataFrame:
    """CPU percent between consecutive readings; counter restarts give no row.

    ``df`` has (connection_id, ts_ms, id, cpu_centis): cumulative CPU time in hundredths of a second.
    """
    seen = with_previous(
        df, ["connection_id"], ["ts_ms", "id"], {"_ms": "ts_ms", "_cpu": "cpu_centis"}, HOUR_MS
    )
    elapsed = F.col("ts_ms") - F.col("_ms")
    used = F.col("cpu_centis") - F.col("_cpu")
    return (
        seen.where((elapsed > 0) & (used >= 0))
        .withColumn("cpu_pct", used * 10 / elapsed * 100)
        .drop("_ms", "_cpu")
    )


#: Exact whole units, and room for the sums of their products.
UNITS, WIDE = "decimal(19,0)", "decimal(38,0)"


def _squares(n: str) -> Column:
    """n * q - s * s over the sums _s and _q, exact."""
    s = F.col("_s").cast(WIDE)
    return F.col(n).cast(WIDE) * F.col("_q").cast(WIDE) - s * s


def rolling_baseline(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    units: str,
    rows: int = BASELINE_ROWS,
    ready: int = BASELINE_READY,
    scale: float = 1.0,
    slice_ms: int = HOUR_MS,
) -> DataFrame:
    """Mean, population deviation and z-score over the last rows, the current one included.

    ``units`` is an integer column (for example cents), so the sums are exact; ``scale``
    turns units back into the reported measure. Squares are summed as wide decimals, so byte
    gauges of any size fit.
    """
    value = F.col(units)
    one, wide = F.lit(1).cast("bigint"), value.cast(UNITS)
    summed = with_trailing_sums(df, keys, order, rows, {"_n": one, "_s": wide, "_q": wide * wide}, slice_ms)
    n = F.col("_n")
    mean = F.col("_s").cast("double") / n
    spread = F.when(n < 2, 0.0).otherwise(F.sqrt(_squares("_n").cast("double")) / n)
    return (
        summed.withColumn("samples", n)
        .withColumn("mean", mean * scale)
        .withColumn("stddev", spread * scale)
        .withColumn("z", F.when(spread == 0, 0.0).otherwise((value - mean) / spread))
        .withColumn("ready", n >= ready)
        .drop("_n", "_s", "_q")
    )


def buffer_warmup(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], units: str,
    rows: int = BASELINE_ROWS, ready: int = BASELINE_READY,
) -> DataFrame:
    """State of each metric buffer now: statistics of its last rows and how ready it is."""
    recent = latest_n_per_group(df, keys, order, rows)
    n, wide = F.col("samples"), F.col(units).cast(UNITS)
    return (
        recent.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.sum(wide).alias("_s"),
            F.sum(wide * wide).alias("_q"),
            F.min(units).alias("min_units"),
            F.max(units).alias("max_units"),
            F.max_by(units, F.struct(*order)).alias("latest_units"),
        )
        .withColumn("mean", F.col("_s").cast("double") / n)
        .withColumn("stddev", F.when(n < 2, 0.0).otherwise(F.sqrt(_squares("samples").cast("double")) / n))
        .withColumn("ready", n >= ready)
        .withColumn("ready_pct", F.least(F.lit(100.0), n / ready * 100))
        .drop("_s", "_q")
    )


def downsample(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_points: int, slice_ms: int = HOUR_MS
) -> DataFrame:
    """Evenly spaced rows of each series, at most ``max_points``, the last one kept."""
    indexed = with_row_index(df, keys, order, "_i", slice_ms)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    i, n = F.col("_i"), F.col("_n")
    step = n / F.lit(max_points)
    guess = F.ceil(i / step)

    def lands(j: Column) -> Column:
        return (j >= 0) & (j <= max_points - 2) & (F.floor(j * step) == i)

    kept = (n <= max_points) | (i == n - 1) | lands(guess - 1) | lands(guess) | lands(guess + 1)
    return indexed.join(sizes, list(keys)).where(kept).drop("_i", "_n")


def forecast(
    df: DataFrame,
    start_ms: int,
    end_ms: int,
    ceiling: Column | float | None = None,
    min_points: int = 3,
    min_span_ms: int = 1_800_000,
    trend_pct: float = 5.0,
) -> DataFrame:
    """Least-squares trend per (connection, metric) over a window and time until the ceiling.

    ``df`` has (connection_id, metric, ts_ms, id, units) with integer units; the sums are
    exact decimals, so no row order and no merge order changes the result.
    """
    x = (F.col("ts_ms") - start_ms).cast("decimal(14,0)")
    y = F.col("units").cast(UNITS)
    sums = (
        df.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") <= end_ms))
        .groupBy("connection_id", "metric")
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.sum(x).alias("sx"),
            F.sum(y).alias("sy"),
            F.sum(x * y).alias("sxy"),
            F.sum(x * x).alias("sxx"),
            F.min("ts_ms").alias("first_ms"),
            F.max("ts_ms").alias("last_ms"),
            F.max_by("units", F.struct("ts_ms", "id")).alias("current_units"),
        )
    )
    n, sx, sy, sxx, sxy = (F.col(c).cast(WIDE) for c in ("points", "sx", "sy", "sxx", "sxy"))
    denominator = n * sxx - sx * sx
    numerator = n * sxy - sx * sy
    slope = F.when(denominator == 0, 0.0).otherwise(numerator.cast("double") / denominator.cast("double"))
    fitted = sums.withColumn("slope", slope).withColumn(
        "intercept",
        (F.col("sy").cast("double") - F.col("slope") * F.col("sx").cast("double")) / F.col("points"),
    )
    at = lambda ms: F.col("slope") * (F.col(ms) - start_ms) + F.col("intercept")
    shaped = fitted.withColumn("_a", at("first_ms")).withColumn("_b", at("last_ms"))
    growth = (
        F.when(F.col("_a") != 0, (F.col("_b") - F.col("_a")) / F.abs("_a") * 100)
        .when(F.col("_b") != 0, 100.0)
        .otherwise(0.0)
    )
    enough = (F.col("points") >= min_points) & (F.col("last_ms") - F.col("first_ms") >= min_span_ms)
    limit = F.lit(None).cast("double") if ceiling is None else F.lit(ceiling).cast("double")
    trend = (
        F.when(F.col("growth_pct") > trend_pct, "rising")
        .when(F.col("growth_pct") < -trend_pct, "falling")
        .otherwise("stable")
    )
    return (
        shaped.withColumn("growth_pct", growth)
        .withColumn("trend", trend)
        .withColumn("_limit", limit)
        .select(
            "connection_id",
            "metric",
            "points",
            "current_units",
            (~enough).alias("insufficient"),
            F.when(enough, F.col("slope") * 3_600_000).alias("growth_per_hour"),
            F.when(enough, F.col("growth_pct")).alias("growth_pct"),
            F.when(enough, F.col("trend")).alias("trend"),
            F.when(
                enough & F.col("_limit").isNotNull(),
                F.when(F.col("current_units") >= F.col("_limit"), 0.0).when(
                    (F.col("trend") == "rising") & (F.col("slope") > 0),
                    (F.col("_limit") - F.col("current_units")) / F.col("slope"),
                ),
            ).alias("time_to_limit_ms"),
        )
    )


def role_transitions(polls: DataFrame) -> DataFrame:
    """Demotions and promotions; ``polls`` has (connection_id, ts_ms, id, role)."""
    role = F.when(F.col("role") == "master", "master").when(
        F.col("role").isin("slave", "replica"), "replica"
    )
    known = polls.withColumn("role", role).where(F.col("role").isNotNull())
    seen = with_previous(known, ["connection_id"], ["ts_ms", "id"], {"prev_role": "role"}, DAY_MS)
    return seen.where(F.col("prev_role") != F.col("role")).select(
        "connection_id",
        "ts_ms",
        "id",
        F.when(F.col("role") == "replica", "demoted").otherwise("promoted").alias("transition"),
        F.when(F.col("role") == "replica", "critical").otherwise("warning").alias("severity"),
    )


def state_transitions(polls: DataFrame, good: str = "ok") -> DataFrame:
    """Cluster state changes; leaving the good state is critical. (connection_id, ts_ms, id, state)."""
    seen = with_previous(polls, ["connection_id"], ["ts_ms", "id"], {"prev_state": "state"}, DAY_MS)
    return seen.where(F.col("prev_state") != F.col("state")).select(
        "connection_id",
        "ts_ms",
        "id",
        "prev_state",
        "state",
        F.when(F.col("state") != good, "critical").otherwise("info").alias("severity"),
    )


def data_loss(polls: DataFrame) -> DataFrame:
    """Primaries that restarted empty and replicas wiped by a resync; loading polls are skipped.

    ``polls`` has (connection_id, ts_ms, id, role, replid, offset, keys, uptime_s, loading).
    """
    fields = ("role", "replid", "offset", "keys", "uptime_s")
    ready = polls.where(~F.col("loading"))
    seen = with_previous(
        ready, ["connection_id"], ["ts_ms", "id"], {f"p_{f}": f for f in fields}, DAY_MS
    )
    restarted = (
        (F.col("replid") != F.col("p_replid"))
        | (F.col("uptime_s") < F.col("p_uptime_s"))
        | (F.col("offset") < F.col("p_offset"))
    )
    both = lambda role: (F.col("p_role") == role) & (F.col("role") == role)
    emptied = both("master") & (F.col("p_keys") > 0) & (F.col("keys") == 0) & restarted
    wiped = (
        both("replica")
        & (F.col("replid") != F.col("p_replid"))
        & (F.col("p_keys") > 0)
        & (F.col("keys") <= F.col("p_keys") * 0.1)
    )
    kind = F.when(emptied, "primary_restarted_empty").when(wiped, "replica_wiped")
    return (
        seen.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("connection_id", "ts_ms", "id", "kind", F.col("p_keys").alias("keys_before"), "keys")
    )


def new_log_entries(polled: DataFrame) -> DataFrame:
    """Entries a poll brings that were not seen before; a smaller top id means the log was reset.

    ``polled`` has (connection_id, captured_ms, id, ...): each poll lists the log's current entries.
    The last seen id after a poll is always the top id of that poll.
    """
    tops = polled.groupBy("connection_id", "captured_ms").agg(F.max("id").alias("_top"))
    seen = with_previous(tops, ["connection_id"], ["captured_ms"], {"_last": "_top"}, DAY_MS)
    fresh = F.col("_last").isNull() | (F.col("_top") < F.col("_last")) | (F.col("id") > F.col("_last"))
    return polled.join(seen, ["connection_id", "captured_ms"]).where(fresh).drop("_top", "_last")


def topology_burst(
    deltas: DataFrame, start_ms: int, end_ms: int, min_calls: int = 10, factor: float = 2.0
) -> DataFrame:
    """Whether refresh calls in the window stand out; ``deltas`` has (connection_id, captured_ms, calls_delta)."""
    medians = exact_quantiles(
        deltas, ["connection_id"], "calls_delta", [Quantile("median", "linear", 0.5)]
    )
    inside = (F.col("captured_ms") >= start_ms) & (F.col("captured_ms") <= end_ms)
    peak = deltas.groupBy("connection_id").agg(F.max(F.when(inside, F.col("calls_delta"))).alias("peak"))
    limit = F.greatest(F.lit(float(min_calls)), F.col("median") * factor)
    return peak.join(medians, "connection_id").select(
        "connection_id", "median", "peak", F.coalesce(F.col("peak") > limit, F.lit(False)).alias("burst")
    )


def config_changes(settings: DataFrame) -> DataFrame:
    """Values that differ from the last report of the same key. (connection_id, captured_ms, name, value)."""
    seen = with_previous(
        settings, ["connection_id", "name"], ["captured_ms"], {"old_value": "value"}, DAY_MS * 7
    )
    return seen.where(F.col("old_value") != F.col("value"))


def acl_changes(rules: DataFrame) -> DataFrame:
    """Users added, removed or altered between consecutive polls; the first poll is silent.

    ``rules`` has (connection_id, captured_ms, username, rule).
    """
    polls = previous_poll(rules).where(F.col("prev_ms").isNotNull())
    now = rules.join(polls, ["connection_id", "captured_ms"]).select(
        "connection_id", "captured_ms", "username", "rule"
    )
    then = (
        rules.withColumnRenamed("captured_ms", "prev_ms")
        .join(polls, ["connection_id", "prev_ms"])
        .select("connection_id", "captured_ms", "username", F.col("rule").alias("old_rule"))
    )
    change = (
        F.when(F.col("old_rule").isNull(), "added")
        .when(F.col("rule").isNull(), "removed")
        .when(F.col("rule") != F.col("old_rule"), "changed")
    )
    return (
        now.join(then, ["connection_id", "captured_ms", "username"], "full")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select("connection_id", "captured_ms", "username", "change")
    )


def index_growth(snapshots: DataFrame, min_samples: int = 3, flat_pct: float = 0.1) -> DataFrame:
    """Documents gained per index over the window. (connection_id, index_name, ts_ms, id, num_docs)."""
    order = F.struct("ts_ms", "id")
    ends = snapshots.groupBy("connection_id", "index_name").agg(
        F.count(F.lit(1)).alias("samples"),
        F.min_by("num_docs", order).alias("first_docs"),
        F.max_by("num_docs", order).alias("last_docs"),
    )
    delta = F.col("last_docs") - F.col("first_docs")
    pct = F.when(F.col("first_docs") > 0, delta / F.col("first_docs") * 100).otherwise(F.lit(0.0))
    return (
        ends.where(F.col("samples") >= min_samples)
        .withColumn("delta", delta)
        .withColumn("delta_pct", pct)
        .withColumn(
            "trend", F.when(F.abs("delta_pct") < flat_pct, "flat").when(delta > 0, "up").otherwise("down")
        )
    )


def series_between(df: DataFrame, filters: Mapping[str, str], start_ms: int, end_ms: int) -> DataFrame:
    """Stored history of one entity in time order."""
    out = df.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") <= end_ms))
    for column, value in filters.items():
        out = out.where(F.col(column) == value)
    return out.orderBy("ts_ms")


def level_escalations(df: DataFrame, keys: Sequence[str], order: Sequence[str], level: str) -> DataFrame:
    """Rows whose level is above the level of the row before (nothing before counts as zero)."""
    seen = with_previous(df, keys, order, {"_level": level}, DAY_MS)
    return seen.where(F.col(level) > F.coalesce("_level", F.lit(0))).drop("_level")


def client_saturation(df: DataFrame, warning: float = 0.80, critical: float = 0.95) -> DataFrame:
    """Escalations of connected clients against the limit. (connection_id, ts_ms, id, clients, max_clients)."""
    used = F.col("clients") / F.col("max_clients")
    level = F.when(used >= critical, 2).when(used >= warning, 1).otherwise(0)
    rated = df.where(F.col("max_clients") > 0).withColumn("used", used).withColumn("level", level)
    return level_escalations(rated, ["connection_id"], ["ts_ms", "id"], "level")


def up_down_edges(df: DataFrame) -> DataFrame:
    """Changes of reachability; the state before the first check is up. (connection_id, ts_ms, id, up)."""
    seen = with_previous(df, ["connection_id"], ["ts_ms", "id"], {"_up": "up"}, DAY_MS)
    return seen.where(F.col("up") != F.coalesce("_up", F.lit(True))).select(
        "connection_id", "ts_ms", "id", F.when(F.col("up"), "up").otherwise("down").alias("edge")
    )
