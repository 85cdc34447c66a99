"""Ranked search of many items at once, with common subexpressions evaluated once.

Documents are scored against items (bags of terms) by a weighted, length-normalised sum of
term frequencies in whole numbers. Many items share terms, so the sets they share are mined
first: the pair of nodes that occurs together in most items becomes a node of its own, again
and again, until no pair is shared. The result is a DAG: leaves are terms, an inner node is the sum of two
others, an item the sum of a few nodes. For a lot of documents every node's partial
accumulator is made once, from its two parts, however many items use it.

Two passes: the first reads the texts and writes, per document, its length and the
frequencies of the items' terms; counts over all documents (how many hold each term, how long
they are) follow from that. The second scores lots of documents along the DAG and keeps the best of
a lot per item; Spark ranks what is left. Items are taken in blocks of BLOCK, one DAG each, so
neither the DAG nor the terms a task holds grow with the number of items.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import LOWER, UPPER, checkpointed, map_rows, with_rank

#: Items of a DAG; documents scored at once; values of the accumulators held at once; terms of an
#: item in which shared sets are mined, the most common first (the others are added one by one).
BLOCK, LOT, CELLS, MINED = 1_000, 512, 4_000_000, 256
#: What is not part of a term becomes a blank; all bytes of characters beyond ASCII stay.
FOLD = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 128 or chr(b) in LOWER or chr(b).isdigit() else 32
    for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _terms_of_items(rows: Iterable[list]) -> Iterator[tuple]:
    for item, text in rows:
        for term in set(terms(text)):
            yield item, term


def postings(rows: Iterable[list], known: dict[bytes, int]) -> Iterator[tuple]:
    """(doc_id, n, terms, tfs) of documents with a term at all; terms by their number in known."""
    for doc_id, text in rows:
        words = terms(text)
        if not words:
            continue
        counts = Counter(words)
        found = sorted((known[w], counts[w]) for w in counts.keys() & known.keys())
        yield doc_id, len(words), [t for t, _ in found], [n for _, n in found]


POSTINGS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


class Plan:
    """The query-sharing DAG of a block of items."""

    def __init__(self, items: list[list[int]], n_leaves: int):
        """items: the leaves of each item, numbers below n_leaves."""
        self.n_leaves = n_leaves
        self.parts: list[tuple[int, int]] = []
        users = Counter(node for item in items for node in set(item))
        common = [sorted((n for n in set(i) if users[n] > 1), key=lambda n: (-users[n], n))[:MINED] for i in items]
        self.mined = [set(c) for c in common]
        self._share()
        self.items = [(set(i) - set(c)) | m for i, c, m in zip(items, common, self.mined, strict=True)]

    def _share(self) -> None:
        """Joins the pair of nodes that most items hold, until no two items share a pair."""
        holders: dict[tuple[int, int], set[int]] = defaultdict(set)
        for at, nodes in enumerate(self.mined):
            for pair in combinations(sorted(nodes), 2):
                holders[pair].add(at)
        holders = {pair: who for pair, who in holders.items() if len(who) > 1}
        by_size: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for pair, who in holders.items():
            by_size[len(who)].add(pair)
        of_node: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for pair in holders:
            for node in pair:
                of_node[node].add(pair)

        def resize(pair: tuple[int, int], gone: set[int]) -> None:
            who = holders[pair]
            by_size[len(who)].discard(pair)
            who -= gone
            if len(who) > 1:
                by_size[len(who)].add(pair)
            else:
                del holders[pair]
                for node in pair:
                    of_node[node].discard(pair)

        size = max(by_size, default=0)
        while size > 1:
            if not by_size[size]:
                size -= 1
                continue
            a, b = pair = min(by_size[size])
            who = set(holders[pair])
            node = self.n_leaves + len(self.parts)
            self.parts.append(pair)
            beside: dict[int, set[int]] = defaultdict(set)
            for at in who:
                self.mined[at] -= {a, b}
                for other in self.mined[at]:
                    beside[other].add(at)
            for old in list(of_node[a] | of_node[b]):
                if old in holders and holders[old] & who:
                    resize(old, who)
            for at in who:
                self.mined[at].add(node)
            for other, with_ in beside.items():
                if len(with_) > 1:
                    new = (other, node)
                    holders[new] = set(with_)
                    by_size[len(with_)].add(new)
                    of_node[other].add(new)
                    of_node[node].add(new)

    def evaluate(self, leaves: np.ndarray) -> np.ndarray:
        """Sums of the items (a row each) from the values of the leaves (a row each)."""
        nodes = np.empty((self.n_leaves + len(self.parts), leaves.shape[1]), dtype=np.int64)
        nodes[: self.n_leaves] = leaves
        for at, (a, b) in enumerate(self.parts, self.n_leaves):
            np.add(nodes[a], nodes[b], out=nodes[at])
        out = np.zeros((len(self.items), leaves.shape[1]), dtype=np.int64)
        for row, item in zip(out, self.items, strict=True):
            for node in item:
                row += nodes[node]
        return out

    @property
    def additions(self) -> int:
        return len(self.parts) + sum(map(len, self.items))


class Best:
    """The k best (score, document) of each item; equal scores by id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(n_items)]
        self.floor = np.ones(n_items, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: list) -> None:
        items, docs = np.nonzero(scores >= self.floor[:, None])
        fresh: dict[int, list[tuple]] = defaultdict(list)
        for item, doc in zip(items.tolist(), docs.tolist(), strict=True):
            doc_id = ids[doc]
            fresh[item].append((-int(scores[item, doc]), doc_id is None, doc_id or 0))
        for item, rows in fresh.items():
            best = sorted(self.rows[item] + rows)[: self.k]
            self.rows[item] = best
            if len(best) == self.k:
                self.floor[item] = -best[-1][0]


def scored(rows: Iterable[list], plan: Plan, weights: np.ndarray, documents: int, length: int, k: int) -> Iterator[tuple]:
    """(item, doc_id, score): of the documents of a task the k best of each item."""
    best, rows = Best(len(plan.items), k), iter(rows)
    lot = max(1, min(LOT, CELLS // max(1, plan.n_leaves + len(plan.parts))))
    while held := list(islice(rows, lot)):
        column = np.repeat(np.arange(len(held)), [len(r[2]) for r in held])
        term = np.array([t for r in held for t in r[2]], dtype=np.int64)
        tf = np.array([t for r in held for t in r[3]], dtype=np.int64)
        m = np.array([100 - 90 + 90 * r[1] * documents // length for r in held], dtype=np.int64)
        leaves = np.zeros((plan.n_leaves, len(held)), dtype=np.int64)
        leaves[term, column] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[column]))
        best.add(plan.evaluate(leaves), [r[0] for r in held])
    for item, found in enumerate(best.rows):
        for score, unknown, doc_id in found:
            yield item, None if unknown else doc_id, -score


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of docs (doc_id, text) for each of items (item_id, text).

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower
    case. N is the number of documents with a term, L the number of their terms, n that of one
    document, df that of documents with a term, tf its frequency in one. A term weighs floor(1000 * ln((2N + 2) /
    (2df + 1))), m = 10 + 90nN div L, and a score is the sum over an item's distinct terms
    of weight * (10^9 tf div (1000 tf + 8m)).

    Whole texts are read. Null and empty texts have no terms: such documents are not counted, such items
    have no rows. Scores of 0 do not count; equal scores come by doc_id, null ids last. Each row of docs is a document, also
    where rows or ids repeat. Rows of items with one item_id (null is one too) are one item
    with the terms of all. Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    pairs = map_rows(items.select(F.col("item_id").cast("string"), "text"), _terms_of_items, "item string, term binary").distinct()
    pairs = checkpointed(pairs)
    numbered = with_rank(pairs.select("item").distinct(), [F.col("item")], "number")
    pairs = checkpointed(pairs.join(numbered.withColumnRenamed("item", "_item"), F.col("item").eqNullSafe(F.col("_item"))))
    blocks = numbered.count() // block + 1
    kind = dict(items.dtypes)["item_id"]
    result = None
    for at in range(blocks):
        mine = pairs.where((F.col("number") >= at * block) & (F.col("number") < (at + 1) * block))
        of_item: dict[int, list[bytes]] = defaultdict(list)
        names: dict[int, str | None] = {}
        for r in mine.select("number", "item", "term").collect():  # the terms of one block of items
            of_item[r["number"]].append(bytes(r["term"]))
            names[r["number"]] = r["item"]
        if not of_item:
            continue
        found = _block(docs, of_item, k)
        if found is None:
            return _none(spark, kind)
        named = F.create_map(*[F.lit(x) for i, n in enumerate(sorted(of_item)) for x in (i, names[n])])
        ranked = found.select(named[F.col("item")].cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        result = ranked if result is None else result.unionByName(ranked)
    return _none(spark, kind) if result is None else result


def _none(spark, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def _block(docs: DataFrame, of_item: dict[int, list[bytes]], k: int) -> DataFrame | None:
    """(item, rank, doc_id, score) for a block of items, by their place in it; None without any document."""
    known = {term: i for i, term in enumerate(sorted({t for ts in of_item.values() for t in ts}))}
    held = checkpointed(map_rows(docs.select("doc_id", "text"), partial(postings, known=known), POSTINGS))
    documents, length = held.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    df = np.zeros(len(known), dtype=np.int64)
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r["t"]] = r["df"]
    weights = np.array([weight(documents, int(n)) for n in df], dtype=np.int64)
    plan = Plan([[known[t] for t in of_item[n]] for n in sorted(of_item)], len(known))
    look = partial(scored, plan=plan, weights=weights, documents=documents, length=length, k=k)
    found = map_rows(held, look, "item int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
