"""Toxicity of texts whose words are disguised: a noisy channel, decoded, then scored.

A writer meant a clean string of letters; the channel put digits and signs for letters (leetspeak),
blanks or marks between letters, or repeated them. A stretch of text that may have gone
through the channel is a lattice: each place offers the letters it may stand for, a run of one letter offers
itself, two and one, a separator offers a gap or nothing. Viterbi finds the path of least cost:
that of the channel's edits plus that of the restored letters under a character language model.
The model (letter classes, contexts of three) is counted over all texts of the input.

Restored texts are scored by a logistic model over words and word beginnings, which is learned from
the labels of rows that are not held out. The features are those whose share among toxic
documents stands out most; at most fit_rows labelled documents train it.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed, map_rows

#: Classes of characters: 0 what is no letter, 1 to 26 a to z (accents off), the rest other letters.
CLASSES = 32
GRAMS = CLASSES**4
#: What a digit or sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Costs of the channel's edits, as negative logarithms.
STANDS_FOR, REPEATED, DROPPED = 1.0, 0.5, 0.7
EDGES = ".,;:!?\"'()[]{}<>#*_-~`´“”„‘’«»…|/\\%&=^"
BUCKETS, FEATURES, FIT_ROWS, HELD_OUT = 1 << 18, 512, 20_000, 5
SHORTEST, LONGEST = 3, 6


def _class_of(code: int) -> int:
    char = chr(code)
    if not char.isalpha():
        return 0
    base = unicodedata.normalize("NFD", char.lower())[0]
    return ord(base) - 96 if "a" <= base <= "z" else 27 + code % 5


NEAR = np.array([_class_of(c) for c in range(0x3000)], dtype=np.uint8)


def classes(text: str) -> np.ndarray:
    """The classes of the characters of a text; what lies beyond the table counts as letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    near = NEAR[np.minimum(codes, len(NEAR) - 1)]
    return np.where(codes < len(NEAR), near, 27 + codes % 5).astype(np.int32)


def count_grams(rows: Iterable[list]) -> Iterator[tuple]:
    """(gram, n) of the texts of a task: four classes in a row, gaps of any width as one, three gaps before a text."""
    total = np.zeros(GRAMS, dtype=np.int64)
    held: list[np.ndarray] = []
    volume = 0

    def add() -> None:
        c = np.concatenate([*held, np.zeros(1, dtype=np.int32)])
        total.__iadd__(np.bincount(((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:], minlength=GRAMS))

    for (text,) in rows:
        if not text:
            continue
        c = classes(text)
        c = c[np.flatnonzero((c != 0) | (np.append(1, c[:-1]) != 0))]
        held += [np.zeros(3, dtype=np.int32), c]
        volume += len(c) + 3
        if volume > 4_000_000:
            add()
            held, volume = [], 0
    if held:
        add()
    for gram in np.flatnonzero(total):
        yield int(gram), int(total[gram])


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative logarithms) of a class after three others, from the texts of all of docs (text)."""
    counts = map_rows(docs.select("text"), count_grams, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = np.zeros(GRAMS)
    found = counts.toPandas()  # GRAMS rows at most
    grams[found["gram"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return costs(grams)


def costs(grams: np.ndarray) -> np.ndarray:
    """Interpolated over shorter and shorter contexts; the more often a context was seen the more it counts."""
    share = np.full(CLASSES, 1 / CLASSES)
    four = grams.reshape([CLASSES] * 4)
    for left in (3, 2, 1, 0):
        seen = four.sum(axis=tuple(range(left)))
        n = seen.sum(axis=-1, keepdims=True)
        share = (seen + 4.0 * share) / (n + 4.0)
    return -np.log(share).astype(np.float32).reshape(-1)


class Channel:
    """Restores stretches of text under a language model (costs)."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def options(self, text: str, at: int) -> list[tuple[str, float, int]]:
        """(letters, cost, next place) that a place of the lattice offers; a blank is a gap."""
        char = text[at]
        if char.isalpha():
            end = at + 1
            while end < len(text) and text[end] == char:
                end += 1
            if end - at < 3:
                return [(char, 0.0, at + 1)]
            return [(text[at:end], 0.0, end), (char * 2, REPEATED, end), (char, REPEATED, end)]
        found = [(letter, STANDS_FOR, at + 1) for letter in LEET.get(char, "")]
        found.append((" ", 0.0, at + 1))
        if char in " ._*-" and 0 < at < len(text) - 1:
            found.append(("", DROPPED, at + 1))
        return found

    def restore(self, text: str) -> str:
        """The letters of the best path; gaps are blanks. Ties go to what options() names first."""
        model = self.model
        waiting: dict[int, dict[int, tuple]] = {0: {0: (0.0, None)}}
        for at in range(len(text)):
            states = waiting.pop(at, None)
            if not states:
                continue
            for letters, price, end in self.options(text, at):
                codes = [0 if c == " " else int(classes(c)[0]) if c > "z" else ord(c) - 96 for c in letters]
                ahead = waiting.setdefault(end, {})
                for state, (cost, path) in states.items():
                    cost += price
                    for code in codes:
                        if code or state % CLASSES:  # a gap after a gap is the same gap
                            gram = state * CLASSES + code
                            cost += float(model[gram])
                            state = gram % CLASSES**3
                    best = ahead.get(state)
                    if best is None or cost < best[0]:
                        ahead[state] = cost, (path, letters)
        ends = waiting.get(len(text), {0: (0.0, None)})
        closing = lambda s, c: c + (float(model[s * CLASSES]) if s % CLASSES else 0.0)
        path = min(ends.items(), key=lambda x: closing(x[0], x[1][0]))[1][1]
        pieces = []
        while path is not None:
            path, letters = path
            pieces.append(letters)
        return "".join(reversed(pieces))


#: A token that may be disguised: a letter beside a digit or sign, one letter three times, or letters held apart by marks.
DISGUISED = re.compile(r"[^\W\d_][0-9@$!|+]|[0-9@$!|+][^\W\d_]|([^\W\d_])\1\1|(?<![^\W\d_])[^\W\d_](?:[._*-]+[^\W\d_]){2}(?![^\W\d_])")
#: Three or more single characters with blanks between them.
SPACED = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")


class Words:
    """The restored words of texts; keeps what distinct tokens give, for `known` tokens at most."""

    def __init__(self, model: np.ndarray, keep=None, known: int = 200_000):
        self.channel, self.keep, self.known, self.cache = Channel(model), keep or (lambda word: word), known, {}

    def of_token(self, token: str) -> frozenset:
        body = token.strip(EDGES)
        if DISGUISED.search(body):
            found = self.channel.restore(body).split()
        else:
            found = [body] if body.isalpha() else re.findall(r"[^\W\d_]+", body)
        return frozenset(x for w in found for x in self.kept(w))

    def kept(self, word: str) -> Iterable[str]:
        return self.keep(word)

    def __call__(self, text: str | None) -> set:
        text = (text or "").lower()
        found: set = set()
        cache = self.cache
        if len(cache) > self.known:
            cache.clear()
        for token in set(text.split()):
            got = cache.get(token)
            if got is None:
                got = cache[token] = self.of_token(token)
            if got:
                found |= got
        for match in SPACED.finditer(text):
            for word in self.channel.restore(match.group()).split():
                found.update(self.kept(word))
        return found


def features(word: str) -> list[str]:
    """The word (closed by a blank) and its beginnings."""
    return [word + " ", *(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def _bucket_counts(rows: Iterable[list], model: np.ndarray) -> Iterator[tuple]:
    """(toxic, bucket, n): documents of each kind with a feature of the bucket; bucket -1 counts all."""
    words, counts = Words(model, features), np.zeros((2, BUCKETS), dtype=np.int64)
    for text, toxic in rows:
        found = {zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in words(text)}
        counts[int(toxic), list(found)] += 1
        yield int(toxic), -1, 1
    for kind, bucket in np.argwhere(counts):
        yield int(kind), int(bucket), int(counts[kind, bucket])


def _matching(rows: Iterable[list], model: np.ndarray, buckets: frozenset) -> Iterator[tuple]:
    """(toxic, features) of documents, only features of the given buckets."""
    words = Words(model, lambda w: [f for f in features(w) if zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS in buckets])
    for text, toxic in rows:
        yield bool(toxic), sorted(words(text))


def standing_out(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float, n: int) -> np.ndarray:
    """The n places whose share among toxic documents is highest above that of others, in standard errors."""
    share = (toxic + other + 1) / (n_toxic + n_other + 2)
    z = (toxic / n_toxic - other / n_other) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_other))
    best = np.lexsort((np.arange(len(z)), -z))[:n]
    return best[z[best] > 3]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label may not be learned from; never for a row without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


class Scorer:
    """A trained model: the language model, the features and their weights."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], bias: float):
        self.model, self.weights, self.bias = model, weights, bias

    def score(self, rows: Iterable[list]) -> Iterator[tuple]:
        """Rows (..., text) with the score in place of the text."""
        heads = {f[:SHORTEST] for f in self.weights}
        picked = lambda w: [f for f in features(w) if f in self.weights] if (w + " ")[:SHORTEST] in heads else ()
        words = Words(self.model, picked)
        for *rest, text in rows:
            total = self.bias + sum(self.weights[f] for f in sorted(words(text)))
            yield *rest, float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """A scorer from docs (doc_id, text) and labels (doc_id, toxic); rows that are held out are not used.

    Of several labels of a document a toxic one counts. Of rows of one doc_id the smallest text is used.
    Without labels of both kinds every text gets the share of toxic ones (0 without labels).
    """
    model = language_model(docs)
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    one = one.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    one = checkpointed(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    known = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")
    known = checkpointed(known.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))
    counted = map_rows(known, partial(_bucket_counts, model=model), "kind int, bucket int, n bigint")
    counts, total = np.zeros((2, BUCKETS)), np.zeros(2)
    for kind, bucket, n in counted.groupBy("kind", "bucket").agg(F.sum("n")).toPandas().itertuples(index=False):
        if bucket < 0:
            total[kind] = n
        else:
            counts[kind, bucket] = n
    if not total.all():
        return Scorer(model, {}, -30.0 if not total[1] else 30.0)
    buckets = standing_out(counts[1], counts[0], total[1], total[0], FEATURES)
    matched = map_rows(known, partial(_matching, model=model, buckets=frozenset(buckets.tolist())), "toxic boolean, features array<string>")
    rows = sorted(((r["toxic"], r["features"]) for r in matched.toLocalIterator()), key=repr)  # fit_rows at most
    y = np.array([r[0] for r in rows], dtype=np.float64)
    names = sorted({f for r in rows for f in r[1]})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)), dtype=bool)
    for line, (_, found) in zip(x, rows, strict=True):
        line[[place[f] for f in found]] = True
    best = standing_out(x[y == 1].sum(0), x[y == 0].sum(0), total[1], total[0], FEATURES)
    w = logistic(x[:, best].astype(np.float64), y)
    return Scorer(model, {names[b]: float(v) for b, v in zip(best, w, strict=False)}, float(w[-1]))


def toxic_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs (doc_id, text).

    score is the probability of label 1 (0 to 1), predicted 1 from 0.5 on. Whole texts are read;
    null and empty ones have no words, so they score what the bias alone gives. Repeated rows
    are repeated in the result, equal texts have equal scores; a row without a doc_id is
    scored, not held out and never learned from. Without a toxic label all score 0. An empty
    table gives an empty one. Other columns are not read.
    """
    scorer = train(docs, labels, fit_rows)
    rows = map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), scorer.score, "doc_id bigint, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
