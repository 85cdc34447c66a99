"""Small state machines shared by history and stream runs.

Each factory returns ``step(state, row)``. Everything that needs no memory of earlier
decisions (levels, deltas, baselines, streaks) is computed as columns before.
"""

from __future__ import annotations


def spike(consecutive: int, cooldown_ms: int):
    """Fire after ``consecutive`` loud rows, then stay quiet for the cooldown. (ts_ms, id, severity, spike)."""

    def step(state, row):
        last = state.get("fired")
        if last is not None and row.ts_ms - last < cooldown_ms:
            return
        if row.severity is None:
            state["n"] = 0
            return
        state["n"] = state.get("n", 0) + 1
        if state["n"] >= consecutive:
            state["fired"], state["n"] = row.ts_ms, 0
            yield (row.ts_ms, row.id, row.severity, "spike" if row.z > 0 else "drop", row.value)

    return step


def anchored_window(width_ms: int):
    """Assign each event the first event of its window; a window ends ``width_ms`` after that event."""

    def step(state, row):
        start = state.get("start")
        if start is None or row.ts_ms - start > width_ms:
            state["start"] = row.ts_ms
            state["head"] = row.id
        yield (row.ts_ms, row.id, state["start"], state["head"])

    return step


def cooldown(wait_ms: int, at_boundary: bool = False, carried: tuple[str, ...] = ()):
    """Pass a row only when enough time went by since the last passed row; its ``carried`` columns come along."""

    def step(state, row):
        last = state.get("at")
        gap = None if last is None else row.ts_ms - last
        if gap is None or gap > wait_ms or (at_boundary and gap == wait_ms):
            state["at"] = row.ts_ms
            yield (row.ts_ms, *[getattr(row, c) for c in carried])

    return step


def sync_after_pressure(memory_ms: int):
    """Syncs (kind 1) with the replica last seen before, if it was pressured then. (ts_ms, kind, addr, pressured).

    The state has the pressured replicas in the order of their last sighting (kind 0), so the newest is at its end.
    """

    def step(state, row):
        if row.kind == 0:
            state.pop(row.addr, None)
            if row.pressured:
                state[row.addr] = row.ts_ms
            return
        for addr in reversed(state):
            if state[addr] == row.ts_ms:
                continue  # seen at this very time
            if row.ts_ms - state[addr] <= memory_ms:
                yield (row.ts_ms, addr)
            break

    return step


def rate_limit(limit: int, window_ms: int):
    """Admit a request if fewer than ``limit`` were admitted in the window before it."""

    def step(state, row):
        admitted = [t for t in state.get("admitted", []) if t > row.ts_ms - window_ms]
        ok = len(admitted) < limit
        if ok:
            admitted.append(row.ts_ms)
        retry = 0 if ok else max(0, admitted[0] + window_ms - row.ts_ms)
        state["admitted"] = admitted
        yield (row.ts_ms, row.id, ok, limit - len(admitted) if ok else 0, retry)

    return step


def pending_costs(hold_ms: int):
    """Give each store's cost to the oldest miss of the prompt still pending. (ts_ms, id, kind, cost)."""

    def step(state, row):
        pending = [p for p in state.get("pending", []) if p[0] >= row.ts_ms - hold_ms]
        if row.kind == "miss":
            pending.append([row.ts_ms, row.id])
        elif pending:
            _, miss = pending.pop(0)
            yield (miss, row.id, row.cost)
        state["pending"] = pending

    return step


def saturation_episode():
    """First corroborated row of a busy episode; evidence must be newer than the last finding or restart.

    Rows carry ``recent`` (dropped replicas of the last minute), ``total`` (all so far) and ``event_ms`` (the last
    event of the last minute), so what is newer than the floor is a difference of totals.
    """

    def step(state, row):
        if row.restart:
            state.update(floor=row.ts_ms, base=row.total, episode=None)
            return
        if state.get("episode") == row.episode:
            return
        floor = state.get("floor")
        drops = row.recent if floor is None else min(row.recent, row.total - state["base"])
        event = row.event_ms is not None and (floor is None or row.event_ms > floor)
        reasons = saturation_reasons(row.rtt_spike, event, drops)
        if reasons:
            state.update(floor=row.ts_ms, base=row.total, episode=row.episode)
            yield (row.ts_ms, row.id, "+".join(reasons))

    return step


def saturation_reasons(rtt_spike: bool, event: bool, drops: int) -> list[str]:
    """What corroborates a busy processor; one dropped replica only does beside something else."""
    reasons = [n for n, ok in (("rtt", rtt_spike), ("events", event)) if ok]
    return [*reasons, "drops"] if drops >= 2 or (drops == 1 and reasons) else reasons


def failover_churn(window_ms: int = 60_000, changes: int = 3, horizon_ms: int = 120_000):
    """Epoch bumps and owner flips of one shard; lower epochs and health flaps are no elections."""

    def step(state, row):
        if not state or row.ts_ms - state["seen"] > 2 * window_ms:
            state.clear()
            state.update(epoch=row.epoch, owner=row.owner, bumps=[], flips=[], fired=None, seen=row.ts_ms)
            return
        state["seen"] = row.ts_ms
        if row.epoch < state["epoch"]:
            return
        flapping = list(row.unhealthy) if row.unhealthy is not None else []
        if row.epoch == state["epoch"] and row.owner != state["owner"] and state["owner"] in flapping:
            return
        if not row.resharding:
            if row.epoch > state["epoch"]:
                state["bumps"].append(row.ts_ms)
            if row.owner != state["owner"]:
                state["flips"].append(row.ts_ms)
        state["epoch"], state["owner"] = row.epoch, row.owner
        if row.resharding:
            return
        recent = lambda times: [t for t in times if row.ts_ms - t <= window_ms]
        state["bumps"], state["flips"] = recent(state["bumps"]), recent(state["flips"])
        n = max(len(state["bumps"]), len(state["flips"]))
        if n >= changes:
            again = state.get("fired") is not None and row.ts_ms - state["fired"] <= horizon_ms
            state.update(bumps=[], flips=[], fired=row.ts_ms)
            yield (row.ts_ms, n, "critical" if again else "warning")

    return step


def election_churn(window_ms: int = 60_000, needed: int = 3):
    """Enough elections inside the window; the counted ones are spent. Each row is one election."""

    def step(state, row):
        times = [t for t in state.get("times", []) if t >= row.ts_ms - window_ms] + [row.ts_ms]
        state["times"] = times
        if len(times) >= needed:
            state["times"] = []
            yield (row.ts_ms, "election_churn", len(times))

    return step


# Bounds of the times derived from a node timeout, milliseconds.
NODE_TIMEOUT_MS = 15_000
NODE_TIMEOUT_MAX_MS = 300_000
RECOVERED_FLOOR_MS = 30_000
FIRE_MARGIN_MS = 10_000


def node_timeout(known: int | None) -> int:
    """The timeout that times are derived from; the default where none is known."""
    return min(known if known is not None and known > 0 else NODE_TIMEOUT_MS, NODE_TIMEOUT_MAX_MS)


def leaderless(recovered_ms: int = 30_000, fire_ms: int = 40_000):
    """Outages without a leader: from first seeking until a leader, commit progress or a quiet spell.

    Rows with a ``node_timeout_ms`` have times of their own: a node seeks again within two timeouts, so
    quiet counts from three on, and an outage is told one timeout after that.
    """
    quiet_ms, told_ms = recovered_ms, fire_ms

    def step(state, row):
        recovered_ms, fire_ms = quiet_ms, told_ms
        if hasattr(row, "node_timeout_ms"):
            timeout = node_timeout(row.node_timeout_ms)
            recovered_ms = max(RECOVERED_FLOOR_MS, 3 * timeout)
            fire_ms = recovered_ms + max(FIRE_MARGIN_MS, timeout)
        seeking = row.role in ("candidate", "pre-candidate")
        if seeking:
            state["seek"] = row.ts_ms
        since = state.get("since")
        progress = since is not None and row.commit > state["commit"]
        settled = since is not None and not seeking and row.ts_ms - state["seek"] >= recovered_ms
        if row.role == "leader" or progress or settled or (not seeking and since is None):
            if state.get("active"):
                yield (row.ts_ms, "leader_recovered", 0)
            state.clear()
            return
        if since is None:
            since = state["since"] = row.ts_ms
            state["commit"] = row.commit
        if row.ts_ms - since >= fire_ms and seeking and not state.get("active"):
            state["active"] = True
            yield (row.ts_ms, "no_leader", row.ts_ms - since)

    return step


def persistence_stall(stall_s: int = 60, warn_s: int = 120, crit_s: int = 600):
    """Failed saves, saves that stop advancing while keys remain, and saves that run too long."""

    def step(state, row):
        if row.status:
            failed = row.status == "err"
            if failed and not state.get("err"):
                yield (row.ts_ms, "error")
            state["err"] = failed
        if not row.in_progress:
            state["track"] = None
            return
        elapsed = max(0, row.elapsed_s or 0)
        track = state.get("track")
        back = track is not None and (
            elapsed < track["elapsed"] or (row.processed is not None and row.processed < track["done"])
        )
        if track is None or back:
            state["track"] = dict(done=row.processed or 0, moved=row.ts_ms, elapsed=elapsed, warned=False, told=False)
            return
        track["elapsed"] = elapsed
        if row.processed is not None and row.processed > track["done"]:
            track["done"], track["moved"] = row.processed, row.ts_ms
        left = row.processed is not None and row.total is not None and row.processed < row.total
        frozen = left and row.ts_ms - track["moved"] >= stall_s * 1000
        if not track["told"] and (frozen or elapsed >= crit_s):
            track["told"] = True
            yield (row.ts_ms, "stall" if frozen else "exceeded")
        elif not track["told"] and not track["warned"] and elapsed >= warn_s:
            track["warned"] = True
            yield (row.ts_ms, "long")

    return step


def forget_rejoin(min_polls: int = 2, min_ms: int = 60_000, keep_ms: int = 21_600_000):
    """Node ids that left the table and came back alive; each row is one sighting of one id.

    Rows carry the poll number, the time of the poll after the sighting before (``left_ms``), the
    time of the poll just before (``prior_ms``) and the number of view resets before this poll.
    """

    def step(state, row):
        last = state.get("poll")
        if last is not None and state.get("left") is None and row.poll - last > 1:
            state.update(left=row.left_ms, absent=0, resets=state["seen_resets"])
        if state.get("left") is not None:
            state["absent"] += row.poll - last - 1
            if row.resets > state["resets"] or row.prior_ms - state["left"] > keep_ms:
                state["left"] = None
            elif row.live:
                if state["absent"] >= min_polls and row.ts_ms - state["left"] >= min_ms:
                    yield (state["left"], row.ts_ms, state["absent"])
                state["left"] = None
        state["poll"], state["seen_resets"] = row.poll, row.resets_with

    return step


def sustained_regression(needed: int = 5, wait_ms: int = 1_800_000):
    """Fire at ``needed`` degraded samples in a row, at most once per cooldown. (ts_ms, degraded)."""

    def step(state, row):
        if not row.degraded:
            state["n"] = 0
            return
        state["n"] = state.get("n", 0) + 1
        last = state.get("fired")
        if state["n"] >= needed and (last is None or row.ts_ms - last >= wait_ms):
            state.update(fired=row.ts_ms, n=0)
            yield (row.ts_ms, row.p99_us, row.baseline_us)

    return step


def reconcile_facts():
    """Operations on one subject: existing facts first (the first one counts), then incoming in order."""

    def step(state, row):
        if not row.incoming:
            if "fact" not in state:
                state["fact"] = [row.statement, row.date or None]
            return
        prior = state.get("fact")
        date = row.date or None
        if row.tombstone:
            if prior is None:
                yield (row.seq, "unmatched_tombstone", None, None)
            elif date and prior[1] and date < prior[1]:
                yield (row.seq, "noop", None, None)
            else:
                state["fact"] = None
                yield (row.seq, "delete", None, None)
            return
        if prior is None:
            op = "add"
        elif prior[0] == row.statement:
            op = "update" if (date or "") > (prior[1] or "") else "noop"
        else:
            op = "update" if date is None or date >= (prior[1] or "") else "noop"
        if op == "noop":
            yield (row.seq, op, None, None)
            return
        state["fact"] = [row.statement, date]
        yield (row.seq, op, row.statement, date)

    return step
