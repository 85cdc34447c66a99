"""Hard negatives by an inverted multi-index.

Vectors are scaled to integers and cut into two halves. Each half space has a codebook
(k-means on a bounded sample); a pair of codewords is a cell, and the inverted index holds
every row in the cell of its two nearest codewords. Rows of a cell lie in blocks of about
BLOCK rows, so a cell of any size spreads over many tasks.

An anchor's score with a row is at most the sum, over both halves, of the score with the
codeword plus the anchor's length times the codeword's radius (and at least that sum with
the radii taken off). A heap over the two sorted lists of half bounds gives cells by
falling sum, without listing all of them (multi-sequence search). Each search has two rounds: the first
looks into the first PROBE cells and so learns a score that the result reaches; the second goes
on from there and stops at the first cell whose bound is below that score - what is not seen
then is certified not to count. So results are exact; the codebooks only decide how much is read.

First the positives of the anchors are searched (best rows of the same label), then, with
the score windows that follow from them, the negatives. The anchors that visit a cell
travel to its blocks in chunks; a block answers with a few rows per anchor.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed, map_rows

#: Rows a cell holds on average, and rows of a block; codewords of a half at most (what a
#: cell holds beyond is in more blocks); rows that train the codebooks; cells of the first round.
CELL, BLOCK, MOST_CODEWORDS, FIT_ROWS, PROBE, CHUNK = 512, 1024, 512, 20_000, 8, 256
SCALE = 256
#: Largest integer up to which every sum of doubles is exact.
EXACT = 2.0**53
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def members(vectors: DataFrame, shift_every: int | None = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, units) of the rows that take part; units are whole numbers held as doubles."""
    x = F.col("embedding")
    whole = vectors.where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    scaled = F.transform(x, lambda v: v.cast("double") * SCALE)
    # floor() of a double is a bigint; beyond 2^53 a double is whole already
    units = F.transform(scaled, lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v))
    label = F.col("label").cast("long")
    if shift_every is not None:
        label = F.when(F.col("vec_id") % shift_every == 0, (label + 1) % labels).otherwise(label)
    rows = whole.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), units.alias("units"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "units")).alias("row"))
    return one.select("vec_id", "row.label", "row.units")


def filled(units: Iterable[list[float]], width: int) -> np.ndarray:
    """A matrix with one row per vector, filled up with zeros to width."""
    out = [row + [0.0] * (width - len(row)) for row in units]
    return np.array(out, dtype=np.float64).reshape(len(out), width)


def packed(row: np.ndarray) -> bytes:
    """The bytes of a row in the narrowest type that holds it; the length tells the type."""
    most = np.abs(row).max(initial=0)
    return row.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64).tobytes()


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    if all(len(r) == 2 * width for r in rows):
        return np.frombuffer(b"".join(rows), dtype=np.int16).reshape(len(rows), width).astype(np.float64)
    kinds = {2 * width: np.int16, 4 * width: np.int32, 8 * width: np.float64}
    return np.array([np.frombuffer(r, dtype=kinds[len(r)]) for r in rows], dtype=np.float64)


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1) - 2 * points @ words.T, axis=1)


def codebook(points: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n codewords at most, by k-means from distinct rows of the sample."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= n:
        return distinct
    words = distinct[np.random.default_rng(1).permutation(len(distinct))[:n]]
    for _ in range(rounds):
        code = nearest(points, words)
        n_each = np.bincount(code, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, code, points)
        words = np.where(n_each[:, None] > 0, sums / np.maximum(n_each, 1)[:, None], words)
    return words


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles where those are exact, else Python integers within a long."""
    most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * anchors.shape[1]
    if most < EXACT:
        return anchors @ rows.T
    whole = [np.array([[int(v) for v in row] for row in side], dtype=object).reshape(side.shape) for side in (anchors, rows)]
    return np.minimum(np.maximum(whole[0] @ whole[1].T, LOWEST), HIGHEST)


def by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over all pairs by falling first[i] + second[j]: the multi-sequence heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)] if len(a) and len(b) else []
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):  # the first column opens the next row
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))


def in_lots(rows: Iterable[list], n: int) -> Iterator[list[list]]:
    rows = iter(rows)
    while lot := list(islice(rows, n)):
        yield lot


class Index:
    """Codebooks, radii and block counts of the cells: what every task knows, bounded by MOST_CODEWORDS."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray], width: int):
        self.words, self.width = words, width
        self.radii = [np.zeros(len(w)) for w in words]
        self.blocks = np.zeros((len(words[0]), len(words[1])), dtype=np.int32)

    def cells(self, rows: Iterable[list]) -> Iterator[tuple]:
        """PLACED of rows (vec_id, label, units)."""
        for lot in in_lots(rows, 1024):
            whole = filled((r[2] for r in lot), self.width)
            sides = split(whole)
            codes = [nearest(p, w) for p, w in zip(sides, self.words, strict=True)]
            far = [np.sqrt(((p - w[c]) ** 2).sum(1)) for p, w, c in zip(sides, self.words, codes, strict=True)]
            for row, line, i, j, ri, rj in zip(lot, whole, *codes, *far, strict=True):
                yield row[0], row[1], packed(line), int(i), int(j), float(ri), float(rj)

    def visits(self, rows: Iterable[list], probe: int, rest: bool) -> Iterator[tuple]:
        """VISITS of rows ASKING: the cells whose bounds allow scores from floor to ceiling.

        The first `probe` of them, or with `rest` those after.
        """
        for lot in in_lots(rows, CHUNK):
            sides = split(unpacked([r[2] for r in lot], self.width))
            lengths = [np.sqrt((p**2).sum(1)) for p in sides]
            middle = [p @ w.T for p, w in zip(sides, self.words, strict=True)]
            wanted: dict[tuple[int, int], list[int]] = {}
            for at, (*_, floor, ceiling, _) in enumerate(lot):
                for i, j in islice(self._order(at, lengths, middle, floor, ceiling), *((probe, None) if rest else (probe,))):
                    wanted.setdefault((i, j), []).append(at)
            for (i, j), who in wanted.items():
                chunk = [dict(zip(("vec_id", "label", "units", "floor", "windows"), (*lot[a][:4], lot[a][5]), strict=True)) for a in who]
                for block in range(int(self.blocks[i, j])):
                    yield i, j, block, chunk

    def _order(self, at: int, lengths, middle, floor: float | None, ceiling: float | None) -> Iterator[tuple[int, int]]:
        slack = [n[at] * r for n, r in zip(lengths, self.radii, strict=True)]
        high = [m[at] + s for m, s in zip(middle, slack, strict=True)]
        low = [m[at] - s for m, s in zip(middle, slack, strict=True)]
        spare = 1 + 1e-9 * sum(float(np.abs(h).max()) for h in high)  # more than the bounds' rounding
        for bound, i, j in by_bound(*high):
            if floor is not None and bound + spare < floor:
                return  # certified: no cell from here on holds a score that counts
            if self.blocks[i, j] and (ceiling is None or low[0][i] + low[1][j] - spare <= ceiling):
                yield i, j


def split(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = (matrix.shape[1] + 1) // 2
    return matrix[:, :half], matrix[:, half:]


PLACED = "vec_id bigint, label bigint, units binary, i int, j int, ri double, rj double"
WINDOWS = "array<struct<positive: bigint, low: bigint, high: bigint>>"
ASKING = ["vec_id", "label", "units", "floor", "ceiling", "windows"]
VISITS = f"i int, j int, block int, chunk array<struct<vec_id: bigint, label: bigint, units: binary, floor: double, windows: {WINDOWS}>>"


def build(rows: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Index, DataFrame, DataFrame] | None:
    """The index, the rows by cell (PLACED) and their blocks; None for an empty table."""
    n, width = rows.agg(F.count("*"), F.max(F.size("units"))).first()
    if not n:
        return None
    width = max(2, width)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("units").collect()
    codewords = min(MOST_CODEWORDS, max(1, math.ceil(math.sqrt(n / CELL))))
    index = Index(tuple(codebook(side, codewords) for side in split(filled((r["units"] for r in drawn), width))), width)
    placed = checkpointed(map_rows(rows, index.cells, PLACED))
    counts = placed.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("ri").alias("ri"), F.max("rj").alias("rj"))
    for r in counts.collect():  # at most MOST_CODEWORDS squared
        index.blocks[r["i"], r["j"]] = -(-r["n"] // BLOCK)
        index.radii[0][r["i"]] = max(index.radii[0][r["i"]], r["ri"])
        index.radii[1][r["j"]] = max(index.radii[1][r["j"]], r["rj"])
    row = F.struct("vec_id", "label", "units").alias("row")
    block = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")
    sized = placed.join(F.broadcast(counts.select("i", "j", "n")), ["i", "j"]).select("i", "j", block, row)
    blocks = sized.groupBy("i", "j", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return index, placed, checkpointed(blocks)


def _of_same_label(pairs: Iterable[list], width: int, n: int) -> Iterator[tuple]:
    """(anchor, row, score): the n best other rows of the anchor's label in each block."""
    for rows, chunk in pairs:
        ids, labels, s = _scored(rows, chunk, width)
        for a, line in zip(chunk, s, strict=True):
            may = (labels == a["label"]) & (ids != a["vec_id"])
            may = np.flatnonzero(may if a["floor"] is None else may & (line >= a["floor"]))
            for x in may[np.argsort(-line[may], kind="stable")[:n]]:  # rows lie by id
                yield a["vec_id"], int(ids[x]), int(line[x])


def _in_windows(pairs: Iterable[list], width: int, n: int) -> Iterator[tuple]:
    """(anchor, positive, row, score): the n best rows of another label in each window and block."""
    for rows, chunk in pairs:
        ids, labels, s = _scored(rows, chunk, width)
        for a, line in zip(chunk, s, strict=True):
            may = np.flatnonzero((labels != a["label"]) & (line >= a["floor"]))
            may = may[np.argsort(-line[may], kind="stable")]
            falling = -line[may]
            for window in a["windows"]:
                start, end = np.searchsorted(falling, -window["high"]), np.searchsorted(falling, -window["low"], side="right")
                for x in may[start : min(end, start + n)]:
                    yield a["vec_id"], window["positive"], int(ids[x]), int(line[x])


def _scored(rows: list[dict], chunk: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.array([r[k] for r in rows], dtype=np.int64) for k in ("vec_id", "label"))
    return ids, labels, scores(unpacked([a["units"] for a in chunk], width), unpacked([r["units"] for r in rows], width))


def first(rows: DataFrame, by: list[str], id_: str, n: int) -> DataFrame:
    """The n rows of each group with the highest scores, equal ones by id, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), id_)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _searched(index: Index, blocks: DataFrame, asking: DataFrame, look, out: str, probe: int, rest: bool) -> DataFrame:
    """What look finds in the blocks of the cells that asking (ASKING) visits."""
    visits = map_rows(asking.select(ASKING), partial(index.visits, probe=probe, rest=rest), VISITS)
    met = blocks.join(visits, ["i", "j", "block"]).select("rows", "chunk")
    return map_rows(met, partial(look, width=index.width), out)


def positives(index: Index, blocks: DataFrame, anchors: DataFrame, n: int, probe: int = PROBE) -> DataFrame:
    """(anchor_id, positive_id, score, rank): the n best other rows of the label of anchors (vec_id, label, units)."""
    look, out = partial(_of_same_label, n=n), "anchor_id bigint, positive_id bigint, score bigint"
    none = {"floor": F.lit(None).cast("double"), "ceiling": F.lit(None).cast("double"), "windows": F.lit(None).cast(WINDOWS)}
    near = _searched(index, blocks, anchors.withColumns(none), look, out, probe, False)
    near = checkpointed(first(near, ["anchor_id"], "positive_id", n).drop("rank"))
    reached = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.when(F.count("*") >= n, F.min("score")).cast("double").alias("floor"))
    again = anchors.withColumns({k: none[k] for k in ("ceiling", "windows")}).join(reached, "vec_id", "left")
    more = _searched(index, blocks, again, look, out, probe, True)
    return checkpointed(first(near.unionByName(more), ["anchor_id"], "positive_id", n))


def negatives(index: Index, blocks: DataFrame, anchors: DataFrame, found: DataFrame, n: int, low: int, high: int, probe: int = PROBE) -> DataFrame:
    """(anchor_id, positive_id, negative_id, score, rank): the n best rows of another label in the window of each positive of found."""
    look, groups = partial(_in_windows, n=n), ["anchor_id", "positive_id"]
    out = "anchor_id bigint, positive_id bigint, negative_id bigint, score bigint"
    p = F.col("score").cast("decimal(25,0)")
    limits = found.select(*groups, F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high"))
    limits = limits.where("low <= high")

    def asking(limits: DataFrame) -> DataFrame:
        window = F.struct(F.col("positive_id").alias("positive"), "low", "high")
        each = limits.groupBy(F.col("anchor_id").alias("vec_id")).agg(
            F.sort_array(F.collect_list(window)).alias("windows"),  # n positives at most
            F.min("low").cast("double").alias("floor"),
            F.max("high").cast("double").alias("ceiling"),
        )
        return anchors.join(each, "vec_id")

    near = _searched(index, blocks, asking(limits), look, out, probe, False)
    near = checkpointed(first(near, groups, "negative_id", n).drop("rank"))
    reached = near.groupBy(*groups).agg(F.when(F.count("*") >= n, F.min("score")).alias("reached"))
    raised = limits.join(reached, groups, "left").withColumn("low", F.greatest("low", "reached")).drop("reached")
    more = _searched(index, blocks, asking(raised), look, out, probe, True)
    return first(near.unionByName(more), groups, "negative_id", n)


def mine(
    vectors: DataFrame,
    anchor_every: int = 50,
    shift_every: int | None = 7,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by anchor_every, in each of which the
    n_positives best other rows of the label and, for each, the n_negatives best rows of
    another label from low to high percent of the positive's score are returned; equal
    scores come by vec_id.

    Rows without a vec_id, a label or a vector, or with a null or non-finite component take
    no part. Of rows that share a vec_id the one of the smallest label, then vector takes
    part. Vectors of other lengths are filled up with zeros, an empty one scores 0 with all.
    Scores are exact; one beyond the range of a long counts as its end. A positive's score below 0
    has no window; anchors without negatives have no rows; an empty table gives none.
    Other columns are not read. fit_rows bounds the sample of the codebooks, nothing else.
    """
    built = build(checkpointed(members(vectors, shift_every)), fit_rows)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    index, placed, blocks = built
    anchors = placed.where(F.col("vec_id") % anchor_every == 0).select("vec_id", "label", "units")
    found = positives(index, blocks, anchors, n_positives)
    hard = negatives(index, blocks, anchors, found, n_negatives, low, high)
    scored = found.select("anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return hard.join(scored, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")
    )
