"""Hard negatives, ranked search and toxicity against plain versions, and on awkward tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import hard_negatives, ranked_search, toxicity
from tests.conftest import SMALL
from tests.llm.test_operators import AWKWARD, COLUMNS, sample

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_negatives(rows, every=50):
    """The negatives of (vec_id, vector, label) by sorting all rows for each anchor."""
    part = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        units = [math.floor(256 * float(np.float32(x))) for x in v]
        row = ((label + 1) % 10 if i % 7 == 0 else label, units)
        part[i] = min(part.get(i, row), row)
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    found = []
    for a, (label, v) in part.items():
        if a % every:
            continue
        ranked = sorted((-dot(v, w), i, kind) for i, (kind, w) in part.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:5]:
            fit = [r for r in ranked if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            found += [(a, p, n, r[1], -s, -r[0]) for n, r in enumerate(fit, 1)]
    return sorted(found)


def clustered(n, seed, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    vectors = centres[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, width))
    vectors[n // 3 : 2 * n // 3] = vectors[0]  # a third is one vector
    return [(i, [float(x) for x in v], int(rng.integers(0, 4))) for i, v in enumerate(vectors.astype(np.float32))]


@pytest.mark.parametrize("cell,block,probe", [(512, 1024, 8), (8, 4, 2)])
def test_hard_negatives_are_those_of_all_rows(spark, monkeypatch, cell, block, probe):
    monkeypatch.setattr(hard_negatives, "CELL", cell)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = clustered(300, 5)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    found = hard_negatives.mine(df, anchor_every=10)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, 10)


def test_hard_negatives_of_awkward_tables(spark):
    big = 3e38
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [2.0, 0.5], 2), (None, [1.0, 1.0], 1), (1, None, 1), (2, [1.0, None], 1),
        (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 2), (5, [1.0, 1.0], None), (6, [], 1), (8, [1.0, 0.25, 0.5], 1),
        (9, [0.75, 0.25], 3), (10, [1.0, 0.25], 1), (11, [0.75, 0.25], 3), (50, [100000.0, 3e9], 1), (51, [90000.0, 2.5e9], 2),
        (52, [100000.0, 2.9e9], 1), (100, [-1.0, -1.0], 1),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("rank", "score", "i", "block", "units", "n")})
    assert sorted(map(tuple, hard_negatives.mine(df).collect())) == plain_negatives(rows)
    assert hard_negatives.mine(spark.createDataFrame([(0, [big], 1), (50, [big], 1), (51, [big], 2)], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).collect() == []


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, 7).astype(float), rng.integers(0, 5, 9).astype(float)
    found = list(hard_negatives.by_bound(a, b))
    assert [f[0] for f in found] == sorted((x + y for x in a for y in b), reverse=True)
    assert {f[1:] for f in found} == set(itertools.product(range(7), range(9)))
    assert list(hard_negatives.by_bound(a[:0], b)) == []


def test_far_cells_are_not_visited():
    """An anchor beside one codeword of three: the other rows of cells are certified not to reach 5e8."""
    words = np.array([[25600.0, 0], [0, 25600.0], [0, 0]])
    index = hard_negatives.Index((words, words), 4)
    index.radii = [np.full(3, 2000.0)] * 2
    index.blocks[:] = 1
    anchor = hard_negatives.packed(np.array([25600.0, 0, 0, 0]))
    seen = lambda floor, ceiling: {v[:2] for v in index.visits([[1, 0, anchor, floor, ceiling, None]], probe=0, rest=True)}
    assert seen(5e8, None) == {(0, 0), (0, 1), (0, 2)}
    assert len(seen(None, None)) == 9
    assert seen(None, 1e8) == {(i, j) for i in (1, 2) for j in range(3)}


def plain_search(docs, items, k=10):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda t: term.findall((t or "").translate(lower))
    rows = [(i, Counter(of(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    n, length = len(rows), sum(r[2] for r in rows)
    df = Counter(w for r in rows for w in r[1])
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(of(text))
    found = []
    for item, ts in terms.items():
        scores = []
        for i, c, size in rows:
            m = 10 + 90 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        found += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=repr)


@pytest.mark.parametrize("block,lot", [(1000, 512), (3, 2)])
def test_search_is_that_of_each_item_alone(spark, monkeypatch, block, lot):
    monkeypatch.setattr(ranked_search, "LOT", lot)
    docs = [(r[0], r[1]) for r in sample(80, 4)] + [(3, "the of AND x"), (None, "Ähre of The the"), (None, None), (200, ""), (7, "ÄHRE 12 one")]
    items = [(1, "the of"), (2, "of The x two"), (2, "words"), (3, None), (4, "nowhere"), (None, "ähre Ähre 12"), (5, "the of x two"), (6, "the of x and"), (7, "of, the; x two words and")]
    found = ranked_search.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block=block)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(docs, items)


def test_search_of_awkward_and_empty_tables(spark):
    docs = spark.createDataFrame(AWKWARD, COLUMNS).withColumns({c: F.lit("clash") for c in ("n", "item", "rank", "score", "terms")})
    items = spark.createDataFrame([(1, "word TEXT soup"), (2, "line über x")], "item_id bigint, text string").withColumn("term", F.lit("clash"))
    found = ranked_search.search(docs, items)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search([(r[0], r[1]) for r in AWKWARD], [(1, "word TEXT soup"), (2, "line über x")])
    none = spark.createDataFrame([], COLUMNS)
    assert ranked_search.search(none, items).collect() == []
    assert ranked_search.search(docs, items.where("false")).collect() == []
    assert ranked_search.search(spark.createDataFrame([(1, None, "", "", 0)], COLUMNS), items).collect() == []


def test_shared_sums_are_the_sums():
    rng = random.Random(8)
    items = [rng.sample(range(30), rng.randint(0, 12)) for _ in range(40)]
    plan = ranked_search.Plan(items, 30)
    leaves = np.array([[rng.randint(0, 10**9) for _ in range(5)] for _ in range(30)], dtype=np.int64)
    want = [[sum(int(leaves[t, d]) for t in item) for d in range(5)] for item in items]
    assert plan.evaluate(leaves).tolist() == want
    pairs = Counter(p for nodes in plan.mined for p in itertools.combinations(sorted(nodes), 2))
    assert max(pairs.values(), default=0) < 2  # nothing shared is left
    assert plan.additions < sum(map(len, items))


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.language_model(spark.read.parquet(f"{SMALL}/documents.parquet"))


def plain_restore(model, channel, text):
    """The cheapest of all paths through the lattice, one after the other."""
    paths = [(0.0, "", 0, 0)]
    done = []
    while paths:
        cost, out, at, state = paths.pop()
        if at == len(text):
            done.append((cost + (float(model[state * toxicity.CLASSES]) if state % toxicity.CLASSES else 0.0), out))
            continue
        for letters, price, end in channel.options(text, at):
            c, s = cost + price, state
            for char in letters:
                code = 0 if char == " " else int(toxicity.classes(char)[0])
                if code or s % toxicity.CLASSES:
                    c += float(model[s * toxicity.CLASSES + code])
                    s = (s * toxicity.CLASSES + code) % toxicity.CLASSES**3
            paths.append((c, out + letters, end, s))
    return min(done)


@pytest.mark.parametrize("text", ["1d10t", "s t u p i d", "stuuupid", "l.0.s3r", "a1b2c3", "", "!!!", "éé1é", "tr4$h", "x+-x"])
def test_viterbi_finds_the_cheapest_path(model, text):
    channel = toxicity.Channel(model)
    assert channel.restore(text) == plain_restore(model, channel, text)[1]


def test_language_model_counts_all_texts(spark):
    """Gaps of any width count as one, and every text starts after three gaps."""
    texts = ["Ab  c!", None, "", "über 12 b", "ab c"]
    grams = np.zeros(toxicity.GRAMS)
    codes = []
    for text in filter(None, texts):
        codes += [0, 0, 0]
        last = 1
        for c in toxicity.classes(text).tolist():
            if c or last:
                codes.append(c)
            last = c
    codes.append(0)
    for at in range(len(codes) - 3):
        a, b, c, d = codes[at : at + 4]
        grams[((a * 32 + b) * 32 + c) * 32 + d] += 1
    model = toxicity.language_model(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    assert np.allclose(model, toxicity.costs(grams))
    assert np.allclose(np.exp(-model.reshape(-1, toxicity.CLASSES).astype(np.float64)).sum(axis=1), 1, atol=1e-4)


DISGUISE = str.maketrans({"i": "1", "o": "0", "e": "3", "a": "4", "s": "5"})


def test_toxic_documents_are_told_from_clean_ones(spark):
    """Held-out labels of sf0.1, as written and with the words of toxic documents disguised."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out()).select("doc_id", "text", "toxic")
    scorer = toxicity.train(docs, labels)
    rows = [tuple(r) for r in known.collect()]
    as_written = list(scorer.score([[t, text] for _, text, t in rows]))
    toxic, clean = ([s >= 0.5 for t, s in as_written if t == kind] for kind in (1, 0))
    print(f"caught {sum(toxic)} of {len(toxic)}, clean marked {sum(clean)} of {len(clean)}")
    assert sum(toxic) > 0.85 * len(toxic) and sum(clean) < 0.02 * len(clean)
    english = ("idiot", "moron", "stupid", "trash", "loser", "worthless", "pathetic", "disgusting", "clown", "scum")
    hit = [text for _, text, t in rows if t == 1 and sum(text.lower().count(w) for w in english) >= 3]
    for disguise in (lambda w: w.translate(DISGUISE), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:], lambda w: ".".join(w)):
        hidden = [re.sub("|".join(english), lambda m: disguise(m.group()), text) for text in hit]
        caught = [s >= 0.5 for _, s in scorer.score([[1, text] for text in hidden])]
        assert sum(caught) > 0.8 * len(caught), (sum(caught), len(caught))


def test_toxicity_of_awkward_and_empty_tables(spark):
    docs = spark.createDataFrame(AWKWARD, COLUMNS).withColumns({c: F.lit("clash") for c in ("score", "toxic", "held_out", "features")})
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 0), (5, 1), (5, 0), (6, 0), (8, 1)], "doc_id bigint, toxic int")
    found = toxicity.toxic_scores(docs, labels).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    same = [r["score"] for r in found if r["doc_id"] in (None, 5)]
    assert len(same) == 3 and len(set(same)) == 1
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert toxicity.toxic_scores(spark.createDataFrame([], COLUMNS), labels).collect() == []
    assert {r["score"] < 0.01 for r in toxicity.toxic_scores(docs, labels.where("false")).collect()} == {True}
    digits = spark.createDataFrame([(1, "1a" * 20_000, "", "", 0), (2, "x" * 300_000, "", "", 0), (3, "a " * 20_000, "", "", 0)], COLUMNS)
    assert toxicity.toxic_scores(digits, labels).count() == 3


def test_scores_do_not_know_ids_or_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxic_scores(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_dotted_numbers_in_linear_time_are_the_pattern():
    import time

    from fleetscope.llm.pii_patterns import PATTERNS, base_spans, spans_of

    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("0123.. 5a") for _ in range(rng.randint(0, 40)))
        assert list(spans_of("ip", text)) == [m.span() for m in PATTERNS["ip"].finditer(text)]
    started = time.perf_counter()
    base_spans("7" * 1_000_000)
    base_spans("1." * 500_000)
    assert time.perf_counter() - started < 5
