"""Stream forms of the detectors: each returns a ``Live`` whose results are those of its history form.

Every step decides from the row before it and a small state; the history forms in
``detectors`` say the same with columns.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from statistics import median

from fleetscope.streaming import folds
from fleetscope.streaming.detectors import ALERT_DEFAULTS, MINUTE_MS, PRESSURE_MEMORY_MS
from fleetscope.streaming.folds import saturation_reasons
from fleetscope.streaming.live import DAY_MS, Live

CONNECTION = ("connection_id",)
POLL = ("ts_ms", "id")


def _escalation(state: dict, level: int) -> bool:
    """Whether level is above that of the row before; keeps it."""
    before, state["level"] = state.get("level") or 0, level
    return level > before


def threshold_alerts(
    subscribers: Sequence[tuple[str, str, float | None, bool]], factor: float = 0.9, defaults: Mapping[str, float] = ALERT_DEFAULTS
) -> Live:
    """First crossings for subscribers (name, alert, threshold or None, above), a bounded list of settings.

    Latched limits are always the lowest ones (the highest, for limits from above), so the state is their
    number: a reading moves it by two binary searches and meets only the limits it crosses.
    """
    asked: dict[tuple[str, bool], dict[float, list[str]]] = {}
    for name, alert, threshold, above in subscribers:
        limit = defaults.get(alert) if threshold is None else threshold
        if limit is not None:
            asked.setdefault((alert, above), {}).setdefault(float(limit), []).append(name)
    # limits from above are mirrored, so that both kinds rise
    limits = {k: sorted(v if k[1] else (-x for x in v)) for k, v in asked.items()}
    kept = {k: [x * (factor if k[1] else 2 - factor) for x in v] for k, v in limits.items()}

    def step(state, row):
        if row.value is None:
            return
        for above, field in ((True, "over"), (False, "under")):
            rising = limits.get((row.alert, above))
            if not rising:
                continue
            value = row.value if above else -row.value
            latched = state.get(field) or 0
            crossed = bisect_right(rising, value)
            for limit in rising[latched:crossed]:
                limit = limit if above else -limit
                for name in sorted(asked[row.alert, above][limit]):
                    yield (row.ts_ms, row.id, name, row.value, limit)
            state[field] = max(crossed, min(latched, bisect_right(kept[row.alert, above], value)))

    return Live(
        ("connection_id", "alert"), ("ts_ms", "id", "alert", "value"), "over int, under int",
        "ts_ms bigint, id bigint, subscriber string, value double, limit_value double", step,
    )


def anomaly_groups(window_ms: int = 5_000) -> Live:
    """Groups of anomalies by first-anchored window, for ``detectors.with_pattern``.

    A group comes out once event time has passed its window, also when its connection stays silent. Held is one
    group per connection: its metrics, not its rows.
    """

    def step(state, row):
        if state.get("start") is None:
            state.update(start=row.ts_ms, head=row.id, n=0, metrics=[], spikes=[], level=0)
        state["end"], state["n"] = row.ts_ms, state["n"] + 1
        if row.metric is not None and row.metric not in state["metrics"]:
            state["metrics"] = [*state["metrics"], row.metric]
        if row.anomaly_type == "spike" and row.metric is not None and row.metric not in state["spikes"]:
            state["spikes"] = [*state["spikes"], row.metric]
        if row.metric == "connections" and not state.get("connected"):
            state["connected"], state["first"] = True, row.anomaly_type
        if row.saturated is not None:
            state["saturated"] = bool(state.get("saturated")) or row.saturated
        state["level"] = max(state["level"], {"critical": 2, "warning": 1}.get(row.severity, 0))
        return ()

    def due(state):
        return None if state.get("start") is None else state["start"] + window_ms

    def close(state):
        yield (
            state["start"], state["head"], state["n"], state["metrics"], state["spikes"], state.get("first"),
            state.get("saturated"), state["level"], state["end"],
        )
        state.clear()

    return Live(
        CONNECTION, (*POLL, "metric", "anomaly_type", "severity", "saturated"),
        "start bigint, head bigint, n bigint, metrics array<string>, spikes array<string>, connected boolean, first string, saturated boolean, level int, end bigint",
        "start_ms bigint, head_id bigint, n bigint, metrics array<string>, spikes array<string>, first_connection string, saturated boolean, level int, end_ms bigint",
        step, quiet_ms=max(DAY_MS, window_ms + 1), due=due, close=close,
    )


def _poll_major(state: dict, rows: Sequence) -> bool:
    """Follows the major version over polls; whether an upgrade window opens at this one.

    ``opened`` is the start of the window that is open or has run out, null after a change downwards.
    """
    major, before = max((r.major for r in rows if r.major is not None), default=None), state.get("major")
    if major is None:
        return False
    state["major"] = major
    if before is None or major == before:
        return False
    rises = major > before
    state.update(opened=rows[0].ts_ms if rises else None, old=before, new=major)
    return rises


def _loudest(rows: Sequence, min_calls: float, top: int) -> set[int]:
    """Places of the rows of a poll's busiest commands that have calls enough."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i].calls_per_min is None, -(rows[i].calls_per_min or 0), rows[i].command))
    return {i for i in order[:top] if rows[i].calls_per_min is not None and rows[i].calls_per_min >= min_calls}


def _worse(now: float | None, base: float | None, factor: float) -> bool:
    return now is not None and base is not None and now >= base * factor and now - base >= 1000


SAMPLE = ("ts_ms", "command", "p99_us", "major", "calls_per_min")


def judged_samples(span_ms: int = DAY_MS, min_calls: float = 60.0, top: int = 20) -> Live:
    """Command samples with whether they count (``eligible``) and lie in an open upgrade window (``owned``).

    It sees all commands of a poll at once. Its table is the input of ``sustained_regressions``, whose key is the command.
    A connection that is silent for 30 days is taken for a new one.
    """

    def step(state, rows):
        _poll_major(state, rows)
        opened, loud = state.get("opened"), _loudest(rows, min_calls, top)
        owned = opened is not None and rows[0].ts_ms <= opened + span_ms
        for i, row in enumerate(rows):
            yield (row.command, row.ts_ms, row.p99_us, i in loud, owned)

    return Live(
        CONNECTION, SAMPLE, "major int, old int, new int, opened bigint",
        "command string, ts_ms bigint, p99_us double, eligible boolean, owned boolean", step,
        order=("ts_ms", "command"), gather=True, quiet_ms=30 * DAY_MS,
    )


def sustained_regressions(factor: float = 2.0, needed: int = 5, wait_ms: int = 1_800_000) -> Live:
    """Commands that stay at twice their median of the last day, on the rows of ``judged_samples``.

    Held per command are the samples of one day.
    """
    fire = folds.sustained_regression(needed, wait_ms)

    def step(state, row):
        at, values = state.get("at") or [], state.get("values") or []
        old = bisect_left(at, row.ts_ms - DAY_MS)
        at, values = at[old:], values[old:]
        if row.eligible:
            known = values[: bisect_right(at, row.ts_ms - 5 * MINUTE_MS)]
            row.baseline_us = median(known) if known else None
            row.degraded = not row.owned and len(known) >= 30 and _worse(row.p99_us, row.baseline_us, factor)
            yield from fire(state, row)
        if row.p99_us is not None:
            at, values = [*at, row.ts_ms], [*values, row.p99_us]
        state["at"], state["values"] = at, values

    return Live(
        ("connection_id", "command"), ("ts_ms", "p99_us", "eligible", "owned"),
        "at array<bigint>, values array<double>, n int, fired bigint", "ts_ms bigint, p99_us double, baseline_us double", step,
        order=("ts_ms",), quiet_ms=DAY_MS + 1,
    )


def upgrade_regressions(
    factor: float = 1.5, needed: int = 5, lookback_ms: int = 6 * 60 * MINUTE_MS, span_ms: int = DAY_MS, min_calls: float = 60.0, top: int = 20
) -> Live:
    """Commands slower after a major upgrade than on the old major line, once per upgrade.

    Held per connection are the samples of the look-back time, and per upgrade one median and streak per command.
    A connection that is silent for 30 days is taken for a new one.
    """

    def step(state, rows):
        now = rows[0].ts_ms
        held = [s for s in state.get("held") or [] if s["at"] >= now - lookback_ms]
        held += [
            {"at": now, "command": r.command, "p99": r.p99_us, "major": r.major} for r in rows if r.p99_us is not None and r.major is not None
        ]
        state["held"] = held
        if _poll_major(state, rows):
            lines: dict[str, list[float]] = {}
            for s in held:
                if s["major"] == state["old"]:
                    lines.setdefault(s["command"], []).append(s["p99"])
            state["base"] = [{"command": c, "p99": median(v), "n": 0} for c, v in lines.items() if len(v) >= 5]
            state["told"] = False
        opened = state.get("opened")
        if opened is None or now > opened + span_ms or state.get("told"):
            return
        base, loud = {b["command"]: b for b in state.get("base") or []}, _loudest(rows, min_calls, top)
        for i, row in enumerate(rows):
            b = base.get(row.command)
            if b is None:
                continue
            slow = i in loud and row.major is not None and row.major >= state["new"] and _worse(row.p99_us, b["p99"], factor)
            b["n"] = b["n"] + 1 if slow else 0
            if b["n"] >= needed:
                state["told"] = True
                grave = row.p99_us >= b["p99"] * 3 or row.p99_us >= 100_000
                yield (opened, now, row.command, b["p99"], row.p99_us, "critical" if grave else "warning")

    return Live(
        CONNECTION, SAMPLE,
        "major int, old int, new int, opened bigint, told boolean, base array<struct<command: string, p99: double, n: int>>, "
        "held array<struct<at: bigint, command: string, p99: double, major: int>>",
        "opened_ms bigint, ts_ms bigint, command string, baseline_us double, p99_us double, severity string", step,
        order=("ts_ms", "command"), gather=True, quiet_ms=30 * DAY_MS,
    )


def control_plane_saturation(cpu_pct: float = 90.0, streak: int = 3) -> Live:
    """A busy processor beside slow probes, control-plane events or dropped replicas, on polls and events in one stream.

    Rows have ``event`` (true for a control-plane event, whose other columns are null). Held are 30 probe times, the
    drops of the last minute and the time of the last event.
    """

    def step(state, rows):
        now = rows[0].ts_ms
        if any(r.event for r in rows):
            state["event"] = now
        fallen = sum(r.replica_drops or 0 for r in rows if not r.event)
        held = [x for x in zip(state.get("drop_ms") or [], state.get("drop_n") or []) if x[0] >= now - MINUTE_MS]
        held += [(now, fallen)] if fallen > 0 else []
        state["drop_ms"], state["drop_n"] = [list(x) for x in zip(*held)] or [[], []]
        for row in rows:
            if not row.event:
                yield from poll(state, row, held)

    def poll(state, row, held):
        probes = [] if row.restart else state.get("probes") or []
        spike = False
        if row.rtt_ms is not None:
            spike = len(probes) >= 5 and row.rtt_ms >= 100 and row.rtt_ms >= sorted(probes)[len(probes) // 2] * 4
            probes = [*probes, row.rtt_ms][-30:]
        state["probes"] = probes
        if row.restart:
            state.update(floor=row.ts_ms, fired=False, streak=0)
            return
        if row.cpu_pct is None:
            return
        if row.cpu_pct < cpu_pct:
            state.update(fired=False, streak=0)
            return
        state["streak"] = (state.get("streak") or 0) + 1
        if state["streak"] < streak or state.get("fired"):
            return
        newest = lambda at: at >= row.ts_ms - MINUTE_MS and (state.get("floor") is None or at > state["floor"])
        event = state.get("event") is not None and newest(state["event"])
        reasons = saturation_reasons(spike, event, sum(n for at, n in held if newest(at)))
        if reasons:
            state.update(floor=row.ts_ms, fired=True)
            yield (row.ts_ms, row.id, "+".join(reasons))

    return Live(
        CONNECTION, (*POLL, "event", "cpu_pct", "rtt_ms", "replica_drops", "restart"),
        "floor bigint, fired boolean, streak int, event bigint, probes array<double>, drop_ms array<bigint>, drop_n array<bigint>",
        "ts_ms bigint, id bigint, reasons string", step, gather=True,
    )


def client_lockout(used_pct: float = 85.0, streak: int = 3) -> Live:
    """Refused connections and clients held at the ceiling."""

    def step(state, row):
        if row.clients is None or not (row.max_clients or 0) > 0:
            return
        base = state.get("base")
        refusing = row.rejected is not None and base is not None and row.rejected > base
        if row.rejected is not None:
            state["base"] = row.rejected
        high = row.clients / row.max_clients * 100 >= used_pct
        state["streak"] = (state.get("streak") or 0) + 1 if high else 0
        held = state["streak"] >= streak
        level = 2 if refusing and held else int(refusing or held)
        top = state.get("top") or 0
        state["top"] = max(top, level) if level else 0
        if level > top:
            yield (row.ts_ms, row.id, level)

    return Live(
        CONNECTION, ("ts_ms", "id", "clients", "max_clients", "rejected"), "base bigint, streak bigint, top int",
        "ts_ms bigint, id bigint, level int", step,
    )


def load_saturation(warning: float = 0.8, critical: float = 0.95, hold: int = 3) -> Live:
    """Busyness that stays in a band; ``last`` is the last settled band, ``low`` the lowest passing dip since."""

    def step(state, row):
        if row.usec_per_cycle is None or row.cycles_per_sec is None or row.usec_per_cycle < 0 or row.cycles_per_sec < 0:
            return
        busy = max(0.0, min(1.0, row.usec_per_cycle * row.cycles_per_sec / 1e6))
        level = 2 if busy >= critical else 1 if busy >= warning else 0
        run, band = state.get("run") or 0, state.get("band")
        if level == band:
            state["run"] = run + 1
        else:
            if band is not None:
                if band == 0 or run >= hold:
                    state["last"], state["low"] = band, 2
                else:
                    state["low"] = min(state.get("low", 2), band)
            state["band"], state["run"] = level, 1
        if level and state["run"] == hold and level > min(state.get("last", 0), state.get("low", 2)):
            yield (row.ts_ms, row.id, busy, level)

    return Live(
        CONNECTION, ("ts_ms", "id", "usec_per_cycle", "cycles_per_sec"), "band int, run bigint, last int, low int",
        "ts_ms bigint, id bigint, busy double, level int", step,
    )


def memory_overhead(warning: float = 0.3, critical: float = 0.5, note_after: int = 10) -> Live:
    """Non-data memory against the memory limit, and one note for a long run of broken accounting."""

    def step(state, row):
        broken = row.overhead > row.used or row.dataset > row.used or (row.dataset_pct is not None and row.dataset_pct > 100)
        state["broken"] = (state.get("broken") or 0) + 1 if broken else 0
        if broken:
            if state["broken"] == note_after:
                yield (row.ts_ms, row.id, 0, "accounting", None)
            return
        if not (row.maxmemory or 0) > 0:
            return
        operational = max(0, row.overhead - row.startup)
        share = operational / row.maxmemory
        squeezed = (
            row.policy is not None and row.policy != "noeviction" and (row.evicted_delta or 0) > 0
            and share >= warning and operational > row.dataset
        )
        level = 2 if share >= critical or squeezed else int(share >= warning)
        if _escalation(state, level):
            yield (row.ts_ms, row.id, level, "overhead", share)

    reads = ("ts_ms", "id", "used", "overhead", "startup", "dataset", "dataset_pct", "maxmemory", "policy", "evicted_delta")
    out = "ts_ms bigint, id bigint, level int, kind string, share double"
    return Live(CONNECTION, reads, "broken bigint, level int", out, step)


def fork_memory_risk(warning: float = 0.8, critical: float = 0.9, write_rate: float = 1000.0) -> Live:
    """Memory peak of a running or projected save."""

    def step(state, row):
        known = (row.system or 0) > 0
        basis = row.used if row.rss is None else row.rss
        live = (basis + (row.cow or 0)) / row.system if known else None
        projected = (basis + row.last_cow) / row.system if known and row.last_cow is not None else None
        pressed = (row.last_cow or 0) > 0 and row.writes_per_sec is not None and row.writes_per_sec >= write_rate
        score = 0
        if known and row.saving:
            score = 21 if live >= critical else 11 if live >= warning else 0
        elif known and row.saving is False and pressed and projected >= warning:
            score = 10
        if _escalation(state, score):
            kind = "projected" if score == 10 else "live"
            yield (row.ts_ms, row.id, "critical" if score == 21 else "warning", kind, live if row.saving else projected)

    reads = ("ts_ms", "id", "saving", "used", "rss", "cow", "last_cow", "system", "writes_per_sec")
    return Live(CONNECTION, reads, "level int", "ts_ms bigint, id bigint, severity string, kind string, share double", step)


def replica_buffer_pressure(warning: float = 0.6, critical: float = 0.9) -> Live:
    """Escalations of each replica's output buffer; the level before counts for five minutes."""

    def step(state, row):
        hard = row.omem / row.hard_bytes if (row.hard_bytes or 0) > 0 else 0.0
        soft = (
            hard < warning and (row.soft_bytes or 0) > 0 and (row.soft_seconds or 0) > 0 and row.omem >= row.soft_bytes * warning
        )
        if hard < warning and not soft:
            state["since"] = None
        elif soft and state.get("since") is None:
            state["since"] = row.ts_ms
        sustained = soft and row.ts_ms - state["since"] > row.soft_seconds * 1000
        level = 2 if hard >= critical else int(hard >= warning or sustained)
        at = state.get("at")
        before = 0 if at is None or row.ts_ms - at > PRESSURE_MEMORY_MS else state.get("level") or 0
        state["at"], state["level"] = row.ts_ms, level
        if level > before:
            yield (row.ts_ms, row.id, level, "soft_sustained" if sustained else "hard_approach")

    reads = ("ts_ms", "id", "omem", "hard_bytes", "soft_bytes", "soft_seconds")
    out = "ts_ms bigint, id bigint, level int, kind string"
    return Live(("connection_id", "addr"), reads, "since bigint, at bigint, level int", out, step)


def unexplained_resyncs(window_ms: int = PRESSURE_MEMORY_MS, needed: int = 2) -> Live:
    """Full syncs beyond replica growth, once per window."""

    def step(state, rows):
        now = rows[0].ts_ms
        recent = [x for x in state.get("odd") or [] if now - x["ts_ms"] <= window_ms]
        grew = False
        for row in rows:
            before = state.get("replicas")
            growth = 0 if before is None or row.replicas is None else max(0, row.replicas - before)
            odd = max(0, (row.sync_full_delta or 0) - growth)
            state["replicas"] = row.replicas
            if odd > 0:
                recent.append({"ts_ms": now, "n": odd})
                grew = True
        state["odd"] = recent
        total = sum(x["n"] for x in recent)
        fired = state.get("fired")
        if grew and total >= needed and (fired is None or now - fired >= window_ms):
            state["fired"] = now
            yield (now, total)

    return Live(
        CONNECTION, ("ts_ms", "id", "sync_full_delta", "replicas"),
        "replicas bigint, odd array<struct<ts_ms: bigint, n: bigint>>, fired bigint", "ts_ms bigint, recent bigint", step, gather=True,
    )


def resync_loop(min_ms: int = 300_000, cycles: int = 2) -> Live:
    """Replicas whose syncs keep failing while the link stays down; one finding per window."""

    def step(state, row):
        if not (row.role in ("slave", "replica") and row.link == "down"):
            state.clear()
            return
        base, was = state.get("base"), state.get("was")
        dropped = base is not None and row.down_s is not None and row.down_s < base
        if "start" not in state or dropped:
            state.update(start=row.ts_ms, failed=0, told=False)
        if not dropped and was and row.syncing is False:
            state["failed"] += 1
        if row.down_s is not None:
            state["base"] = row.down_s
        if row.syncing is not None:
            state["was"] = row.syncing
        if not state["told"] and row.ts_ms - state["start"] >= min_ms and state["failed"] >= cycles:
            state["told"] = True
            yield (row.ts_ms, row.id, state["failed"])

    return Live(
        CONNECTION, ("ts_ms", "id", "role", "link", "down_s", "syncing"),
        "start bigint, base bigint, was boolean, failed bigint, told boolean", "ts_ms bigint, id bigint, failed_cycles bigint", step,
    )


def failover_churn() -> Live:
    """Shards whose owner or epoch keeps changing; rows are the nodes of a shard, gathered per poll."""
    fold = folds.failover_churn(MINUTE_MS)

    class Observation:
        def __init__(self, rows):
            claim = min(((-r.epoch, r.node_id, r.resharding) for r in rows if r.live), default=None)
            self.seen = claim is not None
            if self.seen:
                self.ts_ms, self.epoch, self.owner, self.resharding = rows[0].ts_ms, -claim[0], claim[1], claim[2]
                self.unhealthy = sorted({r.node_id for r in rows if r.unhealthy})

    def step(state, rows):
        poll = Observation(rows)
        if poll.seen:
            yield from fold(state, poll)

    return Live(
        ("connection_id", "shard"), ("ts_ms", "node_id", "epoch", "live", "unhealthy", "resharding"),
        "epoch bigint, owner string, bumps array<bigint>, flips array<bigint>, fired bigint, seen bigint",
        "ts_ms bigint, changes bigint, severity string", step, order=("ts_ms", "node_id"), gather=True,
    )


def raft_health(churn_ms: int = MINUTE_MS, recovered_ms: int = 30_000, fire_ms: int = 40_000, timed: bool = False) -> Live:
    """Election churn and leaderless outages of one node; ``timed`` rows have a ``node_timeout_ms`` that sets the times."""
    outage, churn = folds.leaderless(recovered_ms, fire_ms), folds.election_churn(churn_ms)

    def step(state, row):
        elections = {k: state.pop(k) for k in ("times", "term") if k in state}
        yield from outage(state, row)
        if elections.get("term") is not None and row.term is not None and row.term > elections["term"]:
            yield from churn(elections, row)
        elections["term"] = row.term
        state.update(elections)

    return Live(
        CONNECTION, ("ts_ms", "id", "role", "term", "commit", *(["node_timeout_ms"] if timed else [])),
        "seek bigint, since bigint, commit bigint, active boolean, times array<bigint>, term bigint",
        "ts_ms bigint, kind string, amount bigint", step,
    )


def persistence_stall(stall_s: int = 60, warn_s: int = 120, crit_s: int = 600) -> Live:
    """Saves that fail, freeze or run long, per child process."""
    return Live(
        ("connection_id", "child"), ("ts_ms", "id", "in_progress", "elapsed_s", "processed", "total", "status"),
        "err boolean, track struct<done: bigint, moved: bigint, elapsed: bigint, warned: boolean, told: boolean>",
        "ts_ms bigint, reason string", folds.persistence_stall(stall_s, warn_s, crit_s),
    )


def forget_rejoin(min_polls: int = 2, min_ms: int = MINUTE_MS, keep_ms: int = 21_600_000) -> Live:
    """Node ids that left the table and came back; the state holds the nodes seen, ``polls`` the poll count.

    A row is one sighting; the sightings of one poll are gathered. A node away for longer than ``keep_ms`` is dropped from the state.
    """

    def step(state, rows):
        now = rows[0].ts_ms
        poll = (state.get("polls") or 0) + 1
        prior_ms, prior_seen = state.get("prior_ms"), state.get("seen")
        reset = prior_seen is not None and len(rows) <= 1 and prior_seen - len(rows) >= 2
        before = state.get("resets") or 0
        resets_with = before + int(reset)
        nodes = {n["node"]: n for n in state.get("nodes") or []}
        for n in nodes.values():  # whoever was there at the poll before the last, and not at the last, left with the last
            if n["left"] is None and n["poll"] < poll - 1:
                n.update(left=prior_ms, absent=0, resets=n["seen_resets"])
        for row in rows:
            n = nodes.setdefault(row.node_id, {"node": row.node_id, "poll": poll - 1, "left": None, "absent": 0, "resets": 0, "seen_resets": 0})
            if n["left"] is not None:
                n["absent"] += poll - n["poll"] - 1
                if before > n["resets"] or prior_ms - n["left"] > keep_ms:
                    n["left"] = None
                elif row.live:
                    if n["absent"] >= min_polls and now - n["left"] >= min_ms:
                        yield (row.node_id, n["left"], now, n["absent"])
                    n["left"] = None
            n.update(poll=poll, seen_resets=resets_with)
        gone = [k for k, n in nodes.items() if n["left"] is not None and n["poll"] < poll and now - n["left"] > keep_ms]
        for k in gone:
            del nodes[k]
        state.update(polls=poll, prior_ms=now, seen=len(rows), resets=resets_with, nodes=list(nodes.values()))

    node = "node: string, poll: bigint, left: bigint, absent: bigint, resets: bigint, seen_resets: bigint"
    return Live(
        CONNECTION, ("ts_ms", "node_id", "live"), f"polls bigint, prior_ms bigint, seen bigint, resets bigint, nodes array<struct<{node}>>",
        "node_id string, departed_ms bigint, returned_ms bigint, absent_polls bigint", step, order=("ts_ms", "node_id"), gather=True,
    )


def auth_failure_bursts(window_ms: int = 300_000, needed: int = 10, wait_ms: int = 900_000, reason: str = "auth") -> Live:
    """Client addresses with many failures in the window; a counter is known for four windows after its last scan."""

    def step(state, rows):
        rows = [r for r in rows if r.reason == reason]
        if not rows:
            return
        now = rows[0].ts_ms
        known = {e["entry"]: e for e in state.get("entries") or [] if now - e["at"] < window_ms * 4}
        failed = 0
        for row in rows:
            e = known.get(row.entry_id)
            if e is not None:
                failed += max(0, row.count - e["n"])
            elif row.created_ms is not None and row.created_ms >= now - window_ms:
                failed += row.count
            known[row.entry_id] = {"entry": row.entry_id, "n": row.count, "at": now}
        recent = [d for d in state.get("deltas") or [] if d["ts_ms"] > now - window_ms]
        recent.append({"ts_ms": now, "n": failed})
        state["entries"] = list(known.values())
        state["deltas"] = [d for d in recent if d["n"]]
        total, fired = sum(d["n"] for d in recent), state.get("fired")
        if total >= needed and (fired is None or now - fired > wait_ms):
            state["fired"] = now
            yield (now, total)

    return Live(
        ("connection_id", "client_ip"), ("ts_ms", "entry_id", "count", "created_ms", "reason"),
        "entries array<struct<entry: bigint, n: bigint, at: bigint>>, deltas array<struct<ts_ms: bigint, n: bigint>>, fired bigint",
        "ts_ms bigint, failures bigint", step, order=("ts_ms", "entry_id"), gather=True,
    )


def sla_breaches(limit_us: float, wait_ms: int = 600_000) -> Live:
    """Latency above its ceiling: at the start of an episode and after each debounce."""
    fire = folds.cooldown(wait_ms, True)

    def step(state, row):
        if row.p99 is not None and row.p99 <= limit_us:
            state.clear()
            return
        for (ts_ms,) in fire(state, row):
            yield (ts_ms, row.p99)

    return Live(("connection_id", "bucket"), ("ts_ms", "p99"), "at bigint", "ts_ms bigint, p99 double", step, order=("ts_ms",))


def persistence_gate(grace_ms: int) -> Live:
    """Findings that persist over successful polls for the grace time.

    Rows are successful polls (signature null) and findings, gathered per poll; a finding without its poll does not count.
    """

    def step(state, rows):
        if not any(r.signature is None for r in rows):
            return
        now = rows[0].ts_ms
        held = {s["signature"]: s for s in state.get("spells") or []}
        spells = []
        for signature in sorted({r.signature for r in rows if r.signature is not None}):
            s = held.get(signature) or {"signature": signature, "since": now, "told": False}
            if not s["told"] and now - s["since"] >= grace_ms:
                s["told"] = True
                yield (signature, s["since"], now)
            spells.append(s)
        state["spells"] = spells

    return Live(
        CONNECTION, ("ts_ms", "signature"), "spells array<struct<signature: string, since: bigint, told: boolean>>",
        "signature string, since_ms bigint, alert_ms bigint", step, order=("ts_ms", "signature"), gather=True,
    )


def admitted_requests(limit: int, window_ms: int) -> Live:
    """Sliding-window admission; the order of a rate key's requests is inherent, so a key is one task."""
    return Live(
        ("rate_key",), POLL, "admitted array<bigint>",
        "ts_ms bigint, id bigint, admitted boolean, remaining bigint, retry_after_ms bigint", folds.rate_limit(limit, window_ms), quiet_ms=max(window_ms, 1),
    )


def recent_similarity(newest: int = 10_000, keep_ms: int = 7 * DAY_MS) -> Live:
    """Per category the newest similarity samples of a week: how many, their mean and hit rate after each poll.

    The state is a ring: at most ``newest`` samples, none older than ``keep_ms``.
    """

    def step(state, rows):
        now = rows[0].ts_ms
        held = [s for s in state.get("ring") or [] if s["ts_ms"] > now - keep_ms]
        held += [{"ts_ms": now, "score": r.score, "hit": r.result == "hit"} for r in rows]
        state["ring"] = held = held[-newest:]
        yield (now, len(held), sum(s["hit"] for s in held))

    return Live(
        ("category",), ("ts_ms", "id", "score", "result"), "ring array<struct<ts_ms: bigint, score: double, hit: boolean>>",
        "ts_ms bigint, n bigint, hits bigint", step, gather=True, quiet_ms=keep_ms,
    )


#: The moves of a proposal.
MOVES = {("pending", "approved"), ("pending", "rejected"), ("pending", "expired"), ("approved", "applied"), ("approved", "expired")}


def proposal_status(keep_ms: int = 30 * DAY_MS) -> Live:
    """Commands on proposals as compare-and-set: a repeated command and one that finds another status change nothing.

    A row is (ts_ms, id, command, expected, wanted): the first one of a proposal sets it to wanted.
    """

    def step(state, row):
        if row.command in (state.get("done") or []):
            return
        status = state.get("status")
        moved = status is None or (status == row.expected and (status, row.wanted) in MOVES)
        state["done"] = [*(state.get("done") or []), row.command]
        if moved:
            state["status"] = row.wanted
        yield (row.ts_ms, row.id, moved, state["status"])

    return Live(
        ("proposal_id",), ("ts_ms", "id", "command", "expected", "wanted"), "status string, done array<string>",
        "ts_ms bigint, id bigint, moved boolean, status string", step, quiet_ms=keep_ms,
    )
