"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, pairs of words, BYTES bytes) are counted: of the target
(documents labelled good) and of the raw text (all documents). A document's log importance
is the sum over its n-grams of log(p_target / p_raw). k documents are sampled without
replacement, with probability in proportion to importance, by adding Gumbel noise to the log
importance and keeping the k largest sums (Gumbel top-k).

k is not a share set by hand: it is the number of documents whose log importance reaches a
level that is read from labels held out of the fit (every HELD_OUT-th of the sample): the
one with the least cost, where the share of good documents under it costs `care` times as
much as the share of bad ones that reach it.

The raw model counts every document and all scores cover whole texts. Only the label sample
is bounded (`fit_rows` label rows, by hash), as it is sent to all executors. What reaches
the driver is two vectors of BUCKETS counts, whatever the input's size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.llm.common import LOWER, UPPER, checkpointed, map_rows

BUCKETS = 1 << 16
BYTES = 4
FIT_ROWS = 20_000
HELD_OUT = 4
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Buckets of the n-grams of a text; keeps hashes of words it has seen."""

    def __init__(self, buckets: int, known: int = 200_000):
        self.buckets, self.known, self.cache = buckets, known, {}

    def __call__(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.translate(FOLD).split()
        if len(self.cache) > self.known:
            self.cache.clear()
        get, put = self.cache.get, self.cache
        numbers = np.empty(len(words), dtype=np.uint64)
        for i, word in enumerate(words):
            h = get(word)
            if h is None:
                put[word] = h = zlib.crc32(word)
            numbers[i] = h
        pairs = (numbers[:-1] * MIX + numbers[1:] + np.uint64(1)) * MIX >> np.uint64(32)
        pairs[numbers[:-1] == numbers[1:]] = 0  # a repeated word is one event, whatever the word
        grams = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
        if len(grams) >= BYTES:
            rolled = grams[: len(grams) - BYTES + 1].copy()
            for i in range(1, BYTES):
                rolled = rolled << np.uint64(8) | grams[i : len(grams) - BYTES + 1 + i]
            grams = rolled * MIX >> np.uint64(32)
        return (np.concatenate([numbers, pairs, grams]) % np.uint64(self.buckets)).astype(np.int64)


def _counted(rows: Iterable[tuple], buckets: int) -> Iterator[tuple]:
    hasher, counts = Hasher(buckets), np.zeros((2, buckets), dtype=np.int64)
    for text, good in rows:
        own = np.bincount(hasher(text), minlength=buckets)
        counts[0] += own
        if good:
            counts[1] += own
    for kind in (0, 1):
        for bucket in np.flatnonzero(counts[kind]):
            yield kind, int(bucket), int(counts[kind][bucket])


@dataclass(frozen=True)
class Model:
    """log(p_target / p_raw) of each bucket."""

    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> Model:
    """The two models from docs (doc_id, text) and labels (doc_id, good), a bounded table."""
    marked = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id", "left")
    rows = map_rows(marked.select("text", "good"), partial(_counted, buckets=buckets), "kind int, bucket int, n bigint")
    counts = np.zeros((2, buckets))
    for kind, bucket, n in rows.groupBy("kind", "bucket").agg(F.sum("n")).toPandas().itertuples(index=False):
        counts[kind, bucket] = n
    if not counts[1].any():
        return Model(np.zeros(buckets))
    raw, target = (np.log((c + smoothing) / (c.sum() + smoothing * buckets)) for c in counts)
    return Model(target - raw)


def scorer(model: Model, seed: int):
    """A vectorized function of (doc_id as text, text): features, log importance, noisy."""

    @F.pandas_udf("n_features bigint, log_importance double, noisy double")
    def score(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        hasher = Hasher(len(model.weights))
        out = []
        for doc_id, text in zip(ids, texts, strict=True):
            own = hasher(text)
            value = float(model.weights[own].sum())
            digest = xxhash.xxh64_intdigest(f"{doc_id}/{text}", seed) >> 11
            noise = -math.log(-math.log((digest + 0.5) / 2.0**53))
            out.append((len(own), value, value + noise))
        return pd.DataFrame(out, columns=["n_features", "log_importance", "noisy"])

    return score


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column, by passes of 1,024 bins; k is 1 at least."""
    x = F.col(column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    while low is not None and low < high:
        bins = F.least(F.floor((x - low) / (high - low) * 1024), F.lit(1023))
        inside = df.where(x.between(low, high)).groupBy(bins.alias("bin"))
        for row in sorted(inside.agg(F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).collect(), reverse=True):
            if row["n"] >= k:
                low, high = row["a"], row["b"]
                break
            k -= row["n"]
        else:
            return low
    return low


def label_sample(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, good) of at most fit_rows labelled documents, chosen by a hash of the id.

    good is quality 1; a document with several labels is good if all are.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    one = one.groupBy("doc_id").agg(F.min(F.col("quality") == 1).alias("good"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def best_level(scores: np.ndarray, good: np.ndarray, care: float) -> float | None:
    """The score of a good document with the least care * (good lost) + (bad kept), as shares;
    the share lost counts with one standard error more, so that few labels lose less."""
    if not good.any():
        return None
    levels, bad = np.sort(scores[good]), np.sort(scores[~good])
    lost = np.searchsorted(levels, levels) / len(levels)
    kept = 1 - np.searchsorted(bad, levels) / max(len(bad), 1)
    error = np.sqrt(lost * (1 - lost) / len(levels))
    return float(levels[np.argmin(care * (lost + error) + kept)])


def _sampling(docs: DataFrame, labels: DataFrame, care: float, buckets: int, fit_rows: int, seed: int):
    """The scored rows, the scoring column and the smallest noisy value that is kept."""
    sample = checkpointed(label_sample(labels, fit_rows))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(HELD_OUT)) == 0
    model = fit(docs, sample.withColumn("good", F.col("good") & ~held_out), buckets)
    column = scorer(model, seed)(F.col("doc_id").cast("string"), F.col("text")).alias("_score")
    scored = checkpointed(docs.select("doc_id", column).select("doc_id", "_score.*"))
    # at most fit_rows / HELD_OUT labels or so
    known = scored.join(F.broadcast(sample.where(held_out)), "doc_id").select("log_importance", "good").toPandas()
    reach = best_level(known["log_importance"].to_numpy(), known["good"].to_numpy(dtype=bool), care)
    k = 0 if reach is None else scored.where(F.col("log_importance") >= reach).count()
    return scored, column, kth_largest(scored, "noisy", k) if k else None


def resample(
    docs: DataFrame,
    labels: DataFrame,
    care: float = 20.0,
    buckets: int = BUCKETS,
    fit_rows: int = FIT_ROWS,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, n_features, log_importance, noisy, kept) for each row of docs (doc_id, text).

    labels has doc_id and quality. Null and empty texts have no n-grams and importance 1.
    Equal noisy values at the cut are all kept, so repeated rows share their fate. Without
    a held-out document labelled good everything is kept. Other columns are not read.
    """
    scored, _, cut = _sampling(docs, labels, care, buckets, fit_rows, seed)
    return scored.withColumn("kept", F.lit(True) if cut is None else F.col("noisy") >= cut)


def sampled_documents(
    docs: DataFrame,
    labels: DataFrame,
    care: float = 20.0,
    buckets: int = BUCKETS,
    fit_rows: int = FIT_ROWS,
    seed: int = 7,
) -> DataFrame:
    """The rows of docs that resample() keeps, all columns; texts are scored again, not joined."""
    _, column, cut = _sampling(docs, labels, care, buckets, fit_rows, seed)
    return docs if cut is None else docs.where(column["noisy"] >= cut)


def _words(text: str | None, buckets: int) -> list[int]:
    """Buckets of the distinct words of a text, without the marks around them."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split())
    return sorted({zlib.crc32(w.strip(b".,;:!?")) % buckets for w in words})


def _present(rows: Iterable[tuple], buckets: int) -> Iterator[tuple]:
    """Documents that hold each word, of each kind; bucket -1 counts all."""
    for text, toxic in rows:
        yield int(toxic), -1, 1
        for bucket in _words(text, buckets):
            yield int(toxic), bucket, 1


def not_toxic(
    docs: DataFrame,
    labels: DataFrame,
    care: float = 20.0,
    buckets: int = BUCKETS,
    fit_rows: int = FIT_ROWS,
    seed: int = 7,
) -> Column:
    """A condition on text: no word of it tells of labelled toxic documents.

    A word's weight is the log ratio of the shares of toxic and of other labelled documents
    that hold it, less three standard errors; a text has the highest weight of its words. The
    level it may reach is read from held-out labels, as for the importance. Without a toxic
    label, or without any other, everything passes.
    """
    if "toxic" not in labels.columns:
        return F.lit(True)
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    one = one.groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"))
    one = checkpointed(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    known = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(HELD_OUT)) == 0
    rows = map_rows(known.where(~held_out).select("text", "toxic"), partial(_present, buckets=buckets), "kind int, bucket int, n bigint")
    counts, total = np.zeros((2, buckets)), np.zeros(2)
    for kind, bucket, n in rows.groupBy("kind", "bucket").agg(F.sum("n")).toPandas().itertuples(index=False):
        if bucket < 0:
            total[kind] = n
        else:
            counts[kind, bucket] = n
    if not total.all():
        return F.lit(True)
    other, toxic = counts + 0.5
    ratio = np.log(toxic / (total[1] + 1)) - np.log(other / (total[0] + 1))
    weights = np.maximum(ratio - 3 * np.sqrt(1 / toxic + 1 / other), 0)

    @F.pandas_udf("double")
    def highest(texts: pd.Series) -> pd.Series:
        return pd.Series([float(weights[_words(t, buckets)].max(initial=0)) for t in texts], dtype="float64")

    seen = known.where(held_out).select(highest("text").alias("weight"), "toxic").toPandas()
    level = best_level(-seen["weight"].to_numpy(), ~seen["toxic"].to_numpy(dtype=bool), care)
    return F.lit(True) if level is None else highest("text") <= -level
