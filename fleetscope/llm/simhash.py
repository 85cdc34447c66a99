"""SimHash near-duplicates by an inverted index over positional bytes with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes,
so they share at least 5 positional bytes. Posting lists of one byte would hold 1/256 of
all fingerprints each, and tallying them would pair everything with everything. The index
therefore posts four positional bytes at a time: of the 14 planes of the affine space
AG(3,2) over the 8 positions, one holds any 3 given positions, so the four positions of its
complement (again a plane) are shared by the pair. 14 postings of 32 bits are complete.

For each candidate pair the shared positional bytes are tallied; pairs under the guaranteed
minimum of 5 are dropped and the rest verified bit by bit.

Dense clouds of fingerprints (many edits of one text) can put many of them into one
posting. A posting over BUCKET members is never paired: its free bits are cut into 8 units
again (nibbles, bit pairs, bits) and indexed by the same planes, which stays complete. After
the last level a posting leaves 4 bits free, so it holds at most 16 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import LOWER, UPPER, checkpointed, map_rows, smallest_of_component

#: Members of a posting that are paired directly.
BUCKET = 128
UNITS = 8
#: Bytes, nibbles, bit pairs, bits.
LEVELS = 4
PLANES = [set(p) for p in combinations(range(UNITS), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Majority bits of the hashes of all shingles, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        block = range(at, min(n, at + 65_536))
        hashes = np.array([digest(b" ".join(words[i : i + words_per_shingle]), 42) for i in block], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(rows: Iterable[tuple], words_per_shingle: int) -> Iterator[tuple]:
    for doc_id, tie, text in rows:
        yield doc_id, tie, fingerprint(text, words_per_shingle)


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, tie, fp) of every row; null and empty texts have fingerprint 0, tie is a hash
    of the text."""
    return map_rows(
        docs.select("doc_id", tie(), "text"),
        partial(_fingerprints, words_per_shingle=words_per_shingle),
        "doc_id bigint, tie bigint, fp bigint",
    )


def tie() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def finer(mask: int) -> list[int]:
    """The masks that fix, beside the bits of mask, each plane of its free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    width = len(free) // UNITS
    units = [sum(1 << i for i in free[u * width : (u + 1) * width]) for u in range(UNITS)]
    return [mask | sum(units[u] for u in plane) for plane in PLANES]


def near_pairs(distinct: DataFrame, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs of the fingerprints of distinct (fp) at most bits apart.

    bits may be 0 to 3, what the postings are complete for.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the index is complete for up to 3 differing bits")
    spark = distinct.sparkSession
    masks = [0]
    members = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    found: DataFrame | None = None
    for level in range(1, LEVELS + 1):
        step = {m: finer(m) for m in masks}
        if masks == [0]:
            posted = members.withColumn("mask", F.explode(F.array(*[F.lit(signed(m)) for m in step[0]])))
        else:  # a fixed table of at most 2,744 x 14 masks
            rows = [(signed(m), signed(x)) for m, xs in step.items() for x in xs]
            finer_masks = spark.createDataFrame(rows, "mask bigint, next bigint")
            posted = members.join(F.broadcast(finer_masks), "mask").select("fp", F.col("next").alias("mask")).distinct()
        posted = posted.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = posted.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        shared = checkpointed(posted.join(sizes, ["mask", "key"]))
        most = bucket if level < LEVELS else 16  # the last level is always paired
        small = shared.where(F.col("n") <= most)
        left = small.select("mask", "key", F.col("fp").alias("a"))
        right = small.select("mask", "key", F.col("fp").alias("b"))
        differ = F.col("a").bitwiseXOR(F.col("b"))
        same_bytes = sum(
            (F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for i in range(8)
        )
        pairs = (
            left.join(right, ["mask", "key"])
            .where("a < b")
            .where(same_bytes >= UNITS - bits)
            .where(F.bit_count(differ) <= bits)
            .select("a", "b")
        )
        found = pairs if found is None else found.unionByName(pairs)
        members = shared.where(F.col("n") > most).select("fp", "mask")
        masks = sorted({m % (1 << 64) for (m,) in members.select("mask").distinct().collect()})
        if not masks:
            break
    return found.distinct()


def _with_components(docs: DataFrame, bits: int, words_per_shingle: int) -> DataFrame:
    """(doc_id, tie, fp, root, component_id) of each row."""
    marks = checkpointed(fingerprints(docs, words_per_shingle))
    classes = checkpointed(marks.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    roots = smallest_of_component(near_pairs(classes.select("fp"), bits))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return marks.join(named, "fp")


def near_duplicates(docs: DataFrame, bits: int = 3, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    Fingerprints at most bits apart are linked; component_id is the smallest doc_id that
    can be reached over links, itself included. Rows without a doc_id take part in the
    links; a component of only such rows has a null id. Repeated rows are repeated in the
    result; other columns are not read. An empty table gives an empty one.
    """
    return _with_components(docs, bits, words_per_shingle).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, bits: int = 3, words_per_shingle: int = 3) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id.

    Rows without a doc_id stay only if no row of their component has one; among equal ids
    the text with the smallest hash stays, and rows of one id and text count as one.
    """
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie")
    stays = _with_components(docs, bits, words_per_shingle).groupBy("root").agg(F.min(key).alias("stays"))
    return smallest_of_each(docs, stays)


def smallest_of_each(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of docs that stays names by structs stays (unknown, doc_id, tie), each once.

    The join and the removal of repeated rows have the same keys, so texts are shuffled once.
    """
    keys = ["_tie", "_known", "_unknown"]
    known = [F.coalesce("doc_id", F.lit(0)).alias("_known"), F.col("doc_id").isNull().alias("_unknown")]
    named = stays.select("stays.*").select(F.col("tie").alias("_tie"), *known)
    keyed = docs.select("*", tie().alias("_tie"), *known)
    return keyed.join(named, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
