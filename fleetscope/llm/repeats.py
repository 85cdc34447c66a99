"""Suffix-array dedup: maximal repeats of a corpus by common-prefix interval trees.

A suffix array of all suffixes does not fit a cluster's shuffle, and is not needed: only
repeats of at least `least` bytes count. Each window of `least` bytes has an anchor, the
smallest hash of its GRAM-byte substrings; equal windows have equal anchors at equal places.
So the suffixes that start at anchors are a sparse suffix array that holds a suffix of every
repeat, and suffixes with different anchor hashes need not be sorted together.

1. Windows are cut into runs that share an anchor (about two runs per `least` bytes). Runs
   are counted by (anchor, content): equal contents collapse to one, whatever their number.
   A content that occurs twice or more repeats as a whole.
2. Where an anchor has several contents, one text of each is fetched. The suffixes from the
   anchor are sorted; a stack scan over their longest common prefixes gives the interval
   tree. In each interval the texts to the left of the anchor are compared: neighbours in
   their order give the left extensions, which must be diverse for a repeat to be maximal.
   Each such pair of a right and a left extension of at least `least` bytes together is a
   maximal repeat, with all of its members.
3. An anchor with more than MEMBERS contents is not sorted in one task: its windows are
   hashed one by one and counted instead, which finds the same windows.

All occurrences follow by a join of the runs with the contents found.

Two lengths are served by one set of runs: anchors are those of the windows of the shorter
one, and every anchor of a longer window is among them. A run then reaches over the windows
of both lengths that have its anchor, and each maximal repeat counts for the lengths it has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from hashlib import sha256
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed, map_rows, written

LEAST = 400
GRAM = 64
MEMBERS = 2048
#: Windows of a text that are hashed at once.
CHUNK = 1 << 18
PLACE = np.uint64((1 << 20) - 1)
BASE = 0x5851F42D4C957F2D


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, and a random number for each byte."""
    n = CHUNK + 8192
    up = np.full(n, BASE, dtype=np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each substring of gram bytes."""
    up, down, values = _powers()
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values[data] * down[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _reaches(view: np.ndarray, sizes: list[int], gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (place, start, end, anchor): bytes start to end hold the windows of one of the
    sizes that have their anchor at place, as far as one chunk of the text shows them."""
    for start in range(0, len(view) - min(sizes) + 1, CHUNK):
        h = gram_hashes(view[start : start + CHUNK + max(sizes) - 1], gram)
        keyed = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        for size in sizes:
            width = size - gram + 1
            if len(h) < width:
                continue
            place = (smallest(keyed[: CHUNK + width - 1], width) & PLACE).astype(np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
            at = place[cuts[:-1]]
            yield start + at, start + cuts[:-1], start + cuts[1:] - 1 + size, h[at].view(np.int64)


def runs(data: bytes, least: int = LEAST, gram: int = GRAM, longest: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(place, first, last, anchor, content): the windows from place + first to place + last
    have their anchor at place; anchor and content are signed 64-bit hashes.

    With longest, first and last reach on to all windows of longest bytes with that anchor.
    """
    found = list(_reaches(np.frombuffer(data, dtype=np.uint8), sorted({least, longest or least}), gram))
    if not found:
        return
    place, start, end, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    place = place[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    start, end = np.minimum.reduceat(start[order], cuts), np.maximum.reduceat(end[order], cuts)
    for p, a, b, h in zip(place[cuts].tolist(), start.tolist(), end.tolist(), anchor[order][cuts].tolist(), strict=True):
        content = xxhash.xxh64_intdigest(data[a:b], (p - a) & 0xFFFF)
        yield p, a - p, b - least - p, h, content - (1 << 64) if content >> 63 else content


def _runs(rows: Iterable[tuple], least: int, gram: int, longest: int) -> Iterator[tuple]:
    """Runs that are alike in a text, as in one of a short period, are one row with their places."""
    for doc_id, tie, text in rows:
        alike: dict[tuple, list[int]] = {}
        for place, *run in runs((text or "").encode(), least, gram, longest):
            alike.setdefault(tuple(run), []).append(place)
        for run, places in alike.items():
            yield doc_id, tie, places, *run


def _bodies(rows: Iterable[tuple], least: int) -> Iterator[tuple]:
    """The bytes of the wanted runs of each text."""
    for text, wanted in rows:
        data = text.encode()
        for w in wanted:
            body = data[w["place"] + w["first"] : w["place"] + w["last"] + least]
            yield w["anchor"], w["content"], w["n"], w["members"], w["first"], w["last"], body, w["owner"], w["spread"]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high - 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def intervals(lcp: list[int], floor: int) -> Iterator[tuple[int, int, int]]:
    """(length, i, j) of each interval of the tree: a maximal range i..j of sorted strings
    with a common prefix of length >= floor; lcp[k] belongs to strings k and k + 1."""
    stack: list[tuple[int, int]] = []
    for k, length in enumerate([*lcp, -1]):
        left = k
        while stack and stack[-1][0] > length:
            depth, left = stack.pop()
            yield depth, left, k
        if length >= floor and (not stack or stack[-1][0] < length):
            stack.append((length, left))


def maximal_repeats(
    members: list[tuple[bytes, int]], least: int = LEAST
) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of each maximal repeat around an anchor.

    members are texts with the place of their anchor. The repeat reaches left bytes before
    the anchor and right bytes behind it in all members, not further in all of them to
    either side.
    """
    ahead = [text[at:] for text, at in members]
    back = [text[:at][::-1] for text, at in members]
    order = sorted(range(len(members)), key=ahead.__getitem__)
    lcp = [common_prefix(ahead[a], ahead[b]) for a, b in zip(order, order[1:], strict=False)]
    most_left = max(map(len, back), default=0)
    for right, i, j in intervals(lcp, max(1, least - most_left)):
        inside = sorted(order[i : j + 1], key=back.__getitem__)
        left_lcp = [common_prefix(back[a], back[b]) for a, b in zip(inside, inside[1:], strict=False)]
        for left, x, y in intervals(left_lcp, max(0, least - right)):
            own = inside[x : y + 1]
            if _reach(ahead, own) == right:  # else the repeat goes on to the right in all of them
                yield left, right, own


def _reach(ahead: list[bytes], own: list[int]) -> int:
    """Common prefix of all: of the smallest and the largest."""
    return common_prefix(min(ahead[i] for i in own), max(ahead[i] for i in own))


def _by_anchor(rows: Iterable[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """Anchors with their contents, each once; rows come sorted by anchor."""
    for anchor, group in groupby(rows, key=lambda r: r[0]):
        contents = list({r[1]: r for r in group}.values())
        if len(contents) > 1:
            yield anchor, contents


def _repeated(rows: Iterable[tuple], least: int) -> Iterator[tuple]:
    """(anchor, content, from, to, repeat) of each member of each maximal repeat."""
    for anchor, contents in _by_anchor(rows):
        for number, (left, right, own) in enumerate(maximal_repeats([(r[6], -r[4]) for r in contents], least)):
            for i in own:
                yield anchor, contents[i][1], -left, right, number


def _covered(rows: Iterable[tuple], least: int, passage: int) -> Iterator[tuple]:
    """(anchor, content, from, to, across): what the maximal repeats of a content cover
    together; across: those of passage bytes that several documents hold, else those of
    least bytes.

    All of them hold the anchor, so together they are one range.
    """
    for anchor, contents in _by_anchor(rows):
        reach = {across: ([0] * len(contents), [0] * len(contents)) for across in (False, True)}
        owners, spread = [r[7] for r in contents], [r[8] for r in contents]
        for most_left, most_right, own in maximal_repeats([(r[6], -r[4]) for r in contents], passage):
            across = any(owners[i] != owners[own[0]] or spread[i] for i in own)
            for counts, (left, right) in zip((most_left + most_right >= least, across), reach.values(), strict=True):
                if counts:
                    for i in own:
                        left[i], right[i] = max(left[i], most_left), max(right[i], most_right)
        for across, (left, right) in reach.items():
            for i, r in enumerate(contents):
                whole = spread[i] if across else r[2] > 1
                if right[i] and not whole:
                    yield anchor, r[1], -left[i], right[i], across


def _windows(rows: Iterable[tuple], size: int) -> Iterator[tuple]:
    for anchor, content, n, _, first, _, body, owner, spread in rows:
        for k in range(len(body) - size + 1):
            window = xxhash.xxh64_intdigest(body[k : k + size])
            yield anchor, content, n, first + k, window - (1 << 64) if window >> 63 else window, owner, spread


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text) with a null text as empty; rows that are alike share a key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text"))


def corpus_runs(texts: DataFrame, least: int, gram: int, longest: int | None = None) -> DataFrame:
    """The runs of anchors that occur twice or more; only these can share a window."""
    schema = "doc_id bigint, tie bigint, places array<bigint>, first int, last int, anchor bigint, content bigint"
    found = written(map_rows(texts, partial(_runs, least=least, gram=gram, longest=longest or least), schema))
    anchors = found.groupBy("anchor").agg(F.sum(F.size("places")).alias("n")).where("n > 1")
    return written(found.join(anchors, "anchor", "left_semi").select(*found.columns))


def shared_contents(texts: DataFrame, found: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Contents of the runs found, and (bodies) those of anchors with several contents
    with the bytes of one occurrence each.

    owner is one of the documents that hold a content, spread tells if there are several.
    """
    one = F.min(F.struct("doc_id", "tie", F.col("places")[0].alias("place"), "first", "last")).alias("one")
    owner = F.xxhash64("doc_id", "tie")
    contents = found.groupBy("anchor", "content").agg(
        F.sum(F.size("places")).alias("n"), F.min(owner).alias("owner"), (F.min(owner) != F.max(owner)).alias("spread"), one
    )
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("members"))
    shared = checkpointed(contents.join(anchors, "anchor"))
    wanted = shared.where("members > 1").select("anchor", "content", "n", "members", "owner", "spread", "one.*")
    wanted = wanted.groupBy("doc_id", "tie").agg(
        F.collect_list(F.struct("place", "first", "last", "anchor", "content", "n", "members", "owner", "spread")).alias("wanted")
    )
    w, t = wanted.alias("w"), texts.alias("t")
    joined = t.join(w, (F.col("t.tie") == F.col("w.tie")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")))
    bodies = map_rows(
        joined.select("text", "wanted"),
        partial(_bodies, least=least),
        "anchor bigint, content bigint, n bigint, members bigint, first int, last int, body binary, owner bigint, spread boolean",
    )
    return shared, bodies


def _whole(shared: DataFrame, least: int, size: int, across: bool = False) -> DataFrame:
    """Contents with another place, or else (across) document, that have size bytes at least."""
    end = F.col("one.last") + least
    found = shared.where(F.col("spread") if across else F.col("n") > 1).where(end - F.col("one.first") >= size)
    return found.select("anchor", "content", F.col("one.first").alias("from"), end.alias("to"))


def _sorted(bodies: DataFrame, members: int) -> DataFrame:
    return bodies.where(F.col("members") <= members).repartition("anchor").sortWithinPartitions("anchor")


def _counted(bodies: DataFrame, size: int, members: int, across: bool = False) -> DataFrame:
    """The range of repeated windows of each content, for anchors of more than members contents."""
    windows = map_rows(
        bodies.where(F.col("members") > members).dropDuplicates(["anchor", "content"]),
        partial(_windows, size=size),
        "anchor bigint, content bigint, n bigint, `from` int, window bigint, owner bigint, spread boolean",
    )
    several = F.bool_or("spread") | (F.min("owner") != F.max("owner")) if across else F.sum("n") > 1
    twice = windows.groupBy("anchor", "from", "window").agg(several.alias("several")).where("several").drop("several")
    return (
        windows.where("not spread" if across else "n = 1")
        .join(twice, ["anchor", "from", "window"])
        .groupBy("anchor", "content")
        .agg(F.min("from").alias("from"), (F.max("from") + size).alias("to"))
    )


def covered_contents(
    texts: DataFrame, found: DataFrame, least: int = LEAST, members: int = MEMBERS, passage: int | None = None
) -> DataFrame:
    """(anchor, content, from, to, across), relative to the anchor: the range of the bytes
    that each content shares with another place (strings of least bytes) and, across, with
    another document (strings of passage bytes; found are the runs of that length)."""
    passage = passage or least
    shared, bodies = shared_contents(texts, found, passage)
    ranges = map_rows(
        _sorted(bodies, members),
        partial(_covered, least=least, passage=passage),
        "anchor bigint, content bigint, `from` int, `to` int, across boolean",
    )
    for across, size in ((False, least), (True, passage)):
        more = _whole(shared, passage, size, across).unionByName(_counted(bodies, size, members, across))
        ranges = ranges.unionByName(more.withColumn("across", F.lit(across)))
    return ranges


def repeat_occurrences(
    docs: DataFrame, least: int = LEAST, gram: int = GRAM, members: int = MEMBERS
) -> DataFrame:
    """(anchor, repeat, doc_id, start, end): all occurrences of each maximal repeat, in bytes.

    A repeat is named by its anchor's hash and a number: -1 for contents that are copied as
    a whole, -2 for the repeated windows of anchors with more than `members` contents.
    """
    texts = keyed(docs)
    runs_of = corpus_runs(texts, least, gram)
    shared, bodies = shared_contents(texts, runs_of, least)
    by_tree = map_rows(
        _sorted(bodies, members),
        partial(_repeated, least=least),
        "anchor bigint, content bigint, `from` int, `to` int, repeat int",
    )
    whole = _whole(shared, least, least).withColumn("repeat", F.lit(-1))
    counted = _counted(bodies, least, members).withColumn("repeat", F.lit(-2))
    found = by_tree.unionByName(whole).unionByName(counted)
    places = runs_of.join(found, ["anchor", "content"]).withColumn("place", F.explode("places"))
    return places.select(
        "anchor", "repeat", "doc_id", (F.col("place") + F.col("from")).alias("start"), (F.col("place") + F.col("to")).alias("end")
    )


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _kept(rows: Iterable[tuple]) -> Iterator[tuple]:
    for doc_id, text, ranges in rows:
        data = text.encode()
        spans, passages = (
            merged((p + r["from"], p + r["to"]) for r in ranges or [] if r["across"] == across for p in r["places"])
            for across in (False, True)
        )
        digest, at, removed = sha256(), 0, 0
        for start, end in spans:
            digest.update(data[at:start])
            at, removed = end, removed + end - start
        digest.update(data[at:])
        counts = len(passages), sum(end - start for start, end in passages)
        yield doc_id, len(data), removed, len(spans), digest.hexdigest(), [x for span in spans for x in span], *counts


def remove_repeats(
    docs: DataFrame, least: int = LEAST, gram: int = GRAM, members: int = MEMBERS, passage: int | None = None
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_passages, n_passage_bytes)
    for each row of docs.

    Bytes covered by a string of least bytes that also starts at another place, in the same
    document or another, are removed, all occurrences of them; spans lists the starts and
    ends of the removed runs. Null and empty texts lose nothing. Repeated rows are copies of
    each other, so they lose all their windows. Other columns are not read.

    Passages are not removed, only counted: maximal runs of bytes covered by a string of
    passage bytes (not above least, which is the default) that another document holds too.
    Rows alike in doc_id and text are one document here.
    """
    passage = passage or least
    if not gram <= passage <= least:
        raise ValueError("an anchor must fit a window, and a passage the strings that are removed")
    texts = keyed(docs)
    found = corpus_runs(texts, passage, gram, least)
    hits = found.join(covered_contents(texts, found, least, members, passage), ["anchor", "content"])
    ranges = hits.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("places", "from", "to", "across")).alias("ranges"))
    p, t = ranges.alias("p"), texts.alias("t")
    joined = t.join(p, (F.col("t.tie") == F.col("p.tie")) & F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")), "left")
    return map_rows(
        joined.select("t.doc_id", "text", "ranges"),
        _kept,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>, "
        "n_passages bigint, n_passage_bytes bigint",
    )
