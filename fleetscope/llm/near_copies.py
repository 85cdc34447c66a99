"""Near copies by the similarity of their five-word shingles.

Two documents are linked if the sets of their shingles have a Jaccard similarity of
SIMILARITY or more. Candidates come from MinHash: BANDS keys of ROWS minima each, so a pair
at similarity 0.8 shares no key with a probability of (1 - 0.8 ** 5) ** 40 = 1.3e-7, a more
similar one with less. Every candidate is verified on the whole sets of 64-bit shingle hashes.

Documents of one shingle set are one node. Only the groups of linked documents are asked
for, so each bucket first verifies its members against one of them, and then, in blocks of a
bounded size, all pairs of its members that are in different groups still.

With bits, the links of simhash count too: SimHash fingerprints at most that many bits apart,
from its postings of positional bytes. A group is then what links of both kinds connect.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed, join_side, map_rows, smallest_of_component
from fleetscope.llm.simhash import FOLD, fingerprint, near_pairs, smallest_of_each, tie

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
#: Shingles that are hashed at once.
BLOCK = 512
#: Members of a bucket, and their shingles, that one task compares with as many others.
MEMBERS, VOLUME = 2_048, 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(11)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None, known: dict[bytes, int], words_per_shingle: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text; a shorter text is one shingle.

    known keeps hashes of words. Case of ASCII letters does not count.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if len(known) > 200_000:
        known.clear()
    hashes = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        h = known.get(word)
        if h is None:
            known[word] = h = xxhash.xxh3_64_intdigest(word)
        hashes[i] = h
    width = min(words_per_shingle, len(words))
    if not width:
        return hashes
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = _mixed(out * MIX + hashes[i : i + n] + np.uint64(1))
    return np.unique(out)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key of each band from the minima of the hashed shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), BLOCK):
        hashed = own[at : at + BLOCK, None] * _FACTORS + _SHIFTS
        np.minimum(least, hashed.min(axis=0), out=least)
    keys = _BAND.copy()
    for row in least.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * MIX + row)
    return keys


def _marked(rows: Iterable[tuple], words_per_shingle: int, simhashed: bool) -> Iterator[tuple]:
    known: dict[bytes, int] = {}
    for doc_id, tie_, text in rows:
        own = shingles(text, known, words_per_shingle)
        fp = int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))
        sim = fingerprint(text) if simhashed else None
        yield doc_id, tie_, fp, sim, len(own), band_keys(own).view(np.int64).tolist() if len(own) else []


def _sets(rows: Iterable[tuple], words_per_shingle: int) -> Iterator[tuple]:
    known: dict[bytes, int] = {}
    for fp, text in rows:
        yield fp, shingles(text, known, words_per_shingle).view(np.int64).tolist()


def _sets_of(ids: DataFrame, nodes: DataFrame, docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(fp, own), the shingle sets of the nodes in ids (fp)."""
    wanted = checkpointed(nodes.join(ids, "fp", "left_semi").select("fp", "rep.doc_id", "rep.tie"))
    d, w = docs.select("doc_id", tie(), "text").alias("d"), wanted.alias("w")
    same = (F.col("d.tie") == F.col("w.tie")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = join_side(d, w, same).select("fp", "text")
    sets = map_rows(texts, partial(_sets, words_per_shingle=words_per_shingle), "fp bigint, own array<bigint>")
    return checkpointed(sets.dropDuplicates(["fp"]))


def linked(fps: list[int], roots: list[int], sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """Similar pairs of members that connect those which similar pairs connect, but not within a root.

    What a member shares with each other is counted over the postings of its shingles.
    """
    size = np.array([len(x) for x in sets])
    who = np.repeat(np.arange(len(sets)), size)
    _, of, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    postings = who[np.argsort(of, kind="stable")]
    ends = np.cumsum(df)
    group = np.unique(np.array(roots), return_inverse=True)[1]
    start = 0
    for x, n in enumerate(size):
        own = of[start : start + n]
        start += n
        own = own[df[own] > 1]
        if not len(own) or (group == group[x]).all():
            continue
        # the places of all postings of own: each run counts up to its end
        runs = np.cumsum(df[own])
        at = np.arange(runs[-1]) + np.repeat(ends[own] - runs, df[own])
        shared = np.bincount(postings[at], minlength=len(sets))
        for y in np.flatnonzero((shared >= similarity * (n + size - shared)) & (group != group[x])):
            if group[y] != group[x]:
                yield fps[x], fps[y]
                group[group == group[y]] = group[x]


def _links(nodes: DataFrame, docs: DataFrame, similarity: float, words_per_shingle: int) -> DataFrame:
    """Pairs (a, b) of similar nodes that connect all nodes which similar pairs connect."""
    posted = nodes.select("fp", "n", F.explode("keys").alias("key"))
    stars = posted.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("volume"), F.min(F.struct("fp", "n")).alias("star"))
    shared = checkpointed(posted.join(stars.where("members > 1"), "key"))
    sets = _sets_of(shared.select("fp").distinct(), nodes, docs, words_per_shingle)

    first = shared.where(F.col("fp") > F.col("star.fp"))
    first = first.where(F.least("n", "star.n") >= similarity * F.greatest("n", "star.n"))
    pairs = first.select(F.col("star.fp").alias("a"), F.col("fp").alias("b")).distinct()
    left, right = (sets.select(F.col("fp").alias(c), F.col("own").alias(f"_{c}")) for c in ("a", "b"))
    pairs = pairs.join(left, "a").join(right, "b").withColumn("_n", F.size(F.array_intersect("_a", "_b")))
    alike = F.col("_n") >= similarity * (F.size("_a") + F.size("_b") - F.col("_n"))
    links = checkpointed(pairs.where(alike).select("a", "b"))

    roots = smallest_of_component(links).withColumnRenamed("node", "fp")
    rooted = shared.where("members > 2").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpointed(rooted.select("key", "members", "volume", "fp", "root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    blocks = F.ceil(F.greatest(F.col("members") / MEMBERS, F.col("volume") / VOLUME)).cast("int")
    rest = rooted.join(split.select("key"), "key", "left_semi").withColumn("_block", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    rest = rest.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rest = rest.select("key", F.least("_block", "_other").alias("i"), F.greatest("_block", "_other").alias("j"), "fp", "root")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        own = [x.astype(np.int64) for x in group["own"]]
        return pd.DataFrame(linked(group["fp"].tolist(), group["root"].tolist(), own, similarity), columns=["a", "b"], dtype="int64")

    found = rest.join(sets, "fp").groupBy("key", "i", "j").applyInPandas(search, "a bigint, b bigint")
    return links.unionByName(found)


def _simhash_links(marks: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect all nodes whose SimHash fingerprints are linked."""
    held = checkpointed(marks.select("fp", "sim").distinct())
    roots = smallest_of_component(near_pairs(held.select(F.col("sim").alias("fp")).distinct(), bits))
    grouped = held.join(roots.withColumnRenamed("node", "sim"), "sim", "left").select("fp", F.coalesce("root", "sim").alias("root"))
    least = grouped.groupBy("root").agg(F.min("fp").alias("a"), F.max("fp").alias("_last")).where("a < _last")
    return grouped.join(least, "root").where("fp > a").select("a", F.col("fp").alias("b"))


def one_of_each(
    docs: DataFrame, similarity: float = SIMILARITY, words_per_shingle: int = WORDS, bits: int | None = None
) -> DataFrame:
    """docs with one row of each group that links connect: that of the smallest doc_id.

    Texts without words are copies of each other. Rows without a doc_id and repeated ids are
    treated as in simhash.one_of_each. similarity may be SIMILARITY or more, what the bands are made for.
    With bits (0 to 3), texts whose fingerprints simhash links are linked as well.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the bands are made for a similarity of {SIMILARITY} or more")
    marks = checkpointed(
        map_rows(
            docs.select("doc_id", tie(), "text"),
            partial(_marked, words_per_shingle=words_per_shingle, simhashed=bits is not None),
            "doc_id bigint, tie bigint, fp bigint, sim bigint, n bigint, keys array<bigint>",
        )
    )
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie")
    rest = F.any_value(F.struct("n", "keys")).alias("rest")
    nodes = checkpointed(marks.groupBy("fp").agg(F.min(key).alias("rep"), rest).select("fp", "rep", "rest.*"))
    links = _links(nodes, docs, similarity, words_per_shingle)
    if bits is not None:
        links = links.unionByName(_simhash_links(marks, bits))
    roots = smallest_of_component(links)
    rooted = nodes.select("fp", "rep").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    stays = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("rep").alias("stays"))
    return smallest_of_each(docs, stays)
