"""Near copies by five-word shingles against all pairs."""

import random

import pytest

import corpus_pipeline
from fleetscope.llm import near_copies, simhash
from tests.llm.test_operators import AWKWARD, COLUMNS


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The smallest id of each group of texts with a Jaccard similarity of 0.8 or more."""
    sets = [plain_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    order = [(r[0] is None, r[0]) if r[0] is not None else (True,) for r in rows]
    return [x[1] for x in sorted({min(order[j] for j in range(len(rows)) if find(j) == i) for i in map(find, range(len(rows)))})]


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.random()}"
    return words


def family(seed, sizes=(6, 40, 200), copies=25):
    """Texts and copies of them and of their copies, with few and many words replaced."""
    rng = random.Random(seed)
    texts = []
    for size in sizes:
        base = [f"w{rng.randint(0, 5000)}" for _ in range(size)]
        made = [base]
        for _ in range(copies):
            made.append(edited(rng, rng.choice(made), rng.randint(1, max(1, size // 25))))
        texts += made
    rng.shuffle(texts)
    return [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize("members", [8, 2048])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(near_copies, "MEMBERS", members)
    rows = family(3)
    got = near_copies.one_of_each(spark.createDataFrame(rows, COLUMNS))
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows)


def test_the_stage_drops_copies_over_three_bits(spark):
    rng = random.Random(5)
    rows = []
    for i in range(20):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
        rows += [(i, " ".join(words), "en", "s", 0), (100 + i, " ".join(edited(rng, words, 1)), "en", "s", 0)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows) == list(range(20))


def test_awkward_and_empty_tables(spark):
    docs = spark.createDataFrame(AWKWARD, COLUMNS)
    got = sorted(r["doc_id"] for r in near_copies.one_of_each(docs).collect())
    assert got == plain_kept(AWKWARD)
    assert near_copies.one_of_each(docs.where("false")).collect() == []


def test_the_stage_keeps_one_of_what_either_kind_of_link_connects(spark):
    """0 and 2 have near fingerprints but few shingles in common, 2 and 1 many shingles but far fingerprints."""
    rng = random.Random(8)
    unit = [f"w{rng.randint(0, 5000)}" for _ in range(40)]

    def bits(a, b):
        return (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()

    def near():
        while True:
            tails = [[f"t{rng.random()}" for _ in range(24)] for _ in range(2)]
            a, b = (" ".join(unit * 8 + tail) for tail in tails)
            third = " ".join(unit * 2 + tails[1][:-1] + ["x"])
            if bits(a, b) <= 3 < min(bits(a, third), bits(b, third)):
                return a, b, third

    a, b, third = near()
    rows = [(0, a, "en", "s", 0), (2, b, "en", "s", 0), (1, third, "en", "s", 0), (3, "another text", "en", "s", 0)]
    assert plain_kept(rows) == [0, 1, 3]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, 1, 3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 3]


def test_the_stage_keeps_at_most_one_of_each_component_of_op3(spark):
    rows = [(100 + r[0], *r[1:]) for r in family(4, copies=9)]
    docs = spark.createDataFrame([*AWKWARD, *AWKWARD, *rows], COLUMNS)
    kept = corpus_pipeline.near_dedup(spark, docs, "").select("doc_id")
    groups = simhash.near_duplicates(docs).distinct().join(kept.distinct(), "doc_id")
    assert groups.groupBy("component_id").count().where("count > 1").collect() == []
    assert kept.count() == kept.distinct().count()
