"""Personal data by patterns and a character-level BiLSTM-CRF.

The tagger learns from labelled spans: those that the fixed patterns find in a bounded
sample of documents (fit_docs documents, fit_windows windows, by hash). It reads characters
as 16 classes, so it learns the shape of what it tags and its surroundings, and finds spans
of like shape that the patterns miss. Windows with a match that has the size of its kind but
fails its check (a wrong check sum, two entries side by side) are no examples: their shape is
that of the kind. What is tagged must pass such checks itself. The parts of its spans that lie
outside those of the patterns are added.

All kinds hold a digit or an @, so only stretches around these characters are read: every
one of them with MARGIN characters on both sides, joined where they meet. A stretch is cut
into windows of WINDOW characters that overlap by half. Where windows overlap, tag scores
are averaged by the distance from the window's edge, and one Viterbi pass over the whole
stretch decides, so a span across windows is decided once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import map_rows
from fleetscope.llm.pii_patterns import DIGIT, KINDS, base_spans, luhn, undecided
from fleetscope.llm.tagger import WINDOW, Tagger, classes

MARGIN = 24
TRIGGER = re.compile(r"[0-9@](?:.{0,%d}[0-9@])?" % MARGIN, re.S)
#: Windows that are scored together, and characters that one Viterbi pass covers.
BATCH = 512
LONGEST = 200_000
TAGS = 1 + 2 * len(KINDS)
TRIANGLE = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of text around digits and @, at most LONGEST long, in order."""
    joined: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if joined and a <= joined[-1][1] and b - joined[-1][0] <= LONGEST:
            joined[-1][1] = b
        else:
            joined.append([max(a, joined[-1][1]) if joined else a, b])
    return [(a, b) for a, b in joined]


def windows_of(length: int) -> list[int]:
    """Starts of overlapping windows over a stretch."""
    step = WINDOW // 2
    return list(range(0, max(1, length - step), step))


def cut(codes: np.ndarray, start: int) -> np.ndarray:
    """A window of classes, filled up with 0."""
    part = codes[start : start + WINDOW]
    return part if len(part) == WINDOW else np.concatenate([part, np.zeros(WINDOW - len(part), dtype=np.uint8)])


def tags_of(length: int, spans: list[tuple[str, int, int]], start: int) -> np.ndarray:
    """Tags of the characters from start: 0 outside, 1 + 2k at the first of kind k, 2 + 2k behind."""
    tags = np.zeros(length, dtype=np.int64)
    for kind, a, b in spans:
        a, b, k = a - start, b - start, KINDS.index(kind)
        if b <= 0 or a >= length:
            continue
        if a >= 0:
            tags[a] = 1 + 2 * k
        tags[max(0, a + 1) : min(b, length)] = 2 + 2 * k
    return tags


def _examples(rows: Iterable[tuple]) -> Iterator[tuple]:
    for (text,) in rows:
        text = text or ""
        spans = base_spans(text)
        free: list[tuple[str, int, int]] = []
        for span in spans:  # kinds may overlap; the first listed labels the characters
            if all(span[2] <= s or e <= span[1] for _, s, e in free):
                free.append(span)
        unclear = undecided(text)
        for a, b in stretches(text):
            codes = classes(text[a:b])
            near = [(s - a, e - a) for s, e in unclear if s < b and e > a]
            for start in windows_of(b - a):
                if any(s < start + WINDOW and e > start for s, e in near):
                    continue
                window = cut(codes, start)
                tags = tags_of(WINDOW, free, a + start)
                yield window.tobytes().hex(), tags.astype(np.uint8).tobytes().hex(), int(tags.any())


def fit(docs: DataFrame, fit_docs: int = 20_000, fit_windows: int = 4000, steps: int = 300) -> Tagger | None:
    """A tagger trained on the sampled windows, None if none of them holds a span."""
    n = docs.count()
    share = min(1.0, fit_docs / max(n, 1))
    mark = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    rows = map_rows(docs.where(mark < share).select("text"), _examples, "window string, tags string, spans int")
    sample = rows.distinct().orderBy(F.col("spans").desc(), F.xxhash64("window"), "window", "tags").limit(fit_windows).toPandas()
    if not len(sample) or not sample["spans"].any():
        return None
    decode = lambda column: np.stack([np.frombuffer(bytes.fromhex(x), dtype=np.uint8) for x in column])
    tagger = Tagger.new(TAGS)
    tagger.train(decode(sample["window"]), decode(sample["tags"]).astype(np.int64), steps)
    return tagger.small()


def _spans(path: np.ndarray, scores: np.ndarray, start: int) -> Iterator[tuple[str, int, int, float]]:
    """Spans of a decoded stretch with the mean probability of their tags."""
    at = 0
    marked = np.flatnonzero(path)
    while len(marked):
        first = int(marked[0])
        kind = (int(path[first]) - 1) // 2
        end = first + 1
        while end < len(path) and path[end] == 2 + 2 * kind:
            end += 1
        part = scores[first:end]
        odds = np.exp(part - part.max(1, keepdims=True))
        sure = (odds[np.arange(end - first), path[first:end]] / odds.sum(1)).mean()
        yield KINDS[kind], start + first, start + end, float(sure)
        at = end
        marked = marked[np.searchsorted(marked, at) :]


#: What the tagger's spans must hold to count: characters, least and largest number of digits.
NEEDS = {"email": ("@.", 0, 1000), "ip": (".", 4, 12), "card": ("", 13, 19), "phone": ("", 8, 15)}


def plausible(kind: str, found: str, sure: float, least: float) -> bool:
    signs, fewest, most = NEEDS[kind]
    digits = "".join(DIGIT.findall(found))
    fits = all(c in found for c in signs) and fewest <= len(digits) <= most
    return sure >= least and fits and (kind != "card" or luhn(digits))


def parts(text: str, kind: str, a: int, b: int, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a tagged span without the patterns' spans; cards too long for one are cut at blanks."""
    free = [a]
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if s < b and e > a:
            free += [s, e]
    free.append(b)
    for s, e in zip(free[::2], free[1::2], strict=True):
        found = text[s:e] if s < e else ""
        several = kind == "card" and len(DIGIT.findall(found)) > NEEDS["card"][2]
        for m in re.finditer(r"\S+" if several else r"\S(?:.*\S)?", found, re.S):
            yield s + m.start(), s + m.end()


def tagged(items: list[tuple[int, str, int]], tagger: Tagger) -> Iterator[tuple[int, str, int, int, float]]:
    """(key, kind, start, end, sureness) over stretches (key, text, start in its document)."""
    codes = [classes(text) for _, text, _ in items]
    starts = [windows_of(len(c)) for c in codes]
    flat = [(k, s) for k, own in enumerate(starts) for s in own]
    sums = [np.zeros((len(c) + WINDOW, TAGS), dtype=np.float32) for c in codes]
    weights = [np.zeros(len(c) + WINDOW, dtype=np.float32) for c in codes]
    for at in range(0, len(flat), BATCH):
        part = flat[at : at + BATCH]
        scores = tagger.emissions(np.stack([cut(codes[k], s) for k, s in part]))
        for (k, s), own in zip(part, scores, strict=True):
            sums[k][s : s + WINDOW] += own * TRIANGLE[:, None]
            weights[k][s : s + WINDOW] += TRIANGLE
    for (key, text, start), c, total, weight in zip(items, codes, sums, weights, strict=True):
        scores = total[: len(c)] / weight[: len(c), None]
        if not (scores.argmax(1) > 0).any():
            continue
        for kind, a, b, sure in _spans(tagger.best_path(scores), scores, start):
            yield key, kind, a, b, sure


def _found(rows: Iterable[tuple], tagger: Tagger | None, least: float) -> Iterator[tuple]:
    held: list[tuple] = []
    volume = 0
    for doc_id, text in rows:
        text = text or ""
        own = stretches(text) if tagger else []
        held.append((doc_id, text, base_spans(text), own))
        volume += 1000 + sum(b - a for a, b in own)
        if volume > 200_000:
            yield from _finished(held, tagger, least)
            held, volume = [], 0
    yield from _finished(held, tagger, least)


def _finished(held: list[tuple], tagger: Tagger | None, least: float) -> Iterator[tuple]:
    added: dict[int, list[tuple[str, int, int]]] = {}
    items = [(i, text[a:b], a) for i, (_, text, _, own) in enumerate(held) for a, b in own]
    for i, kind, a, b, sure in tagged(items, tagger) if items else ():
        text, base = held[i][1], held[i][2]
        for s, e in parts(text, kind, a, b, base):
            if plausible(kind, text[s:e], sure, least):
                added.setdefault(i, []).append((kind, s, e))
    for i, (doc_id, _, base, _) in enumerate(held):
        extra = added.get(i, [])
        every = sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
        counts = [sum(s[0] == kind for s in base) for kind in KINDS]
        digest = hashlib.sha256(_joined(base).encode()).hexdigest()
        yield doc_id, *counts, digest, _joined(every), len(extra)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(
    docs: DataFrame, fit_docs: int = 20_000, fit_windows: int = 4000, steps: int = 300, least: float = 0.7
) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for each row of docs.

    Counts and base_sha256 are of the patterns' spans; spans lists all as kind:start:end in
    code points, end exclusive, by kind, then start. Null and empty texts have no spans,
    repeated rows get equal results; columns other than doc_id and text are not read. If
    the sample holds no span at all, the patterns stand alone.
    """
    tagger = fit(docs, fit_docs, fit_windows, steps)
    return map_rows(
        docs.select("doc_id", "text"),
        partial(_found, tagger=tagger, least=least),
        "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string, n_added bigint",
    )
