"""Each operator against a plain version, and on awkward tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import functions as F

from fleetscope.llm import (
    apportion, byte_bpe, host_reputation, importance, line_rules, merkle, pii_tagger, repeats, simhash, site_lines,
)
from fleetscope.llm.common import n_words, smallest_of_component, with_rank
from fleetscope.llm.pii_patterns import KINDS, PATTERNS, base_spans, passes, undecided
from fleetscope.llm.tagger import Tagger
from tests.conftest import SMALL

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word soup, again. " * 20_000
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (None, "Some text here.", "en", "b", 15),
    (5, "Some text here.", "en", "b", 15), (5, "Some text here.", "en", "b", 15), (6, LONG, "en", None, len(LONG)),
    (7, "über\x85zwei\u3000Wörter\x1fx", "de", "b", 21), (8, "line\nline\n\n\nline", "en", "c", 16),
]


def sample(n=60, seed=1, words=("the", "of", "Ähre", "and,", "x.", "line\n", "two words.", "\n\n", "a|b")):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += texts[:8] + [t + " more" for t in texts[8:14]]
    return [(i, t, "en", f"s{rng.randint(0, 4)}", len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), COLUMNS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like results."""
    rows = spark.createDataFrame(AWKWARD, COLUMNS)
    for name in ("size", "taken", "fp", "key", "rank", "kept", "n_lines", "fingerprint", "target", "seats", "tie", "place"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def runs_of(labels):
    rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return {
        "lines": line_rules.clean_lines,
        "simhash": simhash.near_duplicates,
        "one": simhash.one_of_each,
        "bpe": lambda d: byte_bpe.token_digests(d, rank_file, pattern),
        "importance": lambda d: importance.resample(d, labels),
        "sampled": lambda d: importance.sampled_documents(d, labels),
        "mix": apportion.mix,
        "mixed": apportion.mixed_documents,
        "merkle": merkle.edit_likeness,
        "prints": merkle.fingerprints,
        "sites": site_lines.drop_boilerplate,
        "pii": lambda d: pii_tagger.find_personal_data(d, steps=2),
        "repeats": repeats.remove_repeats,
        "occurrences": repeats.repeat_occurrences,
    }


NAMES = sorted(runs_of(None))
ONE_EACH = set(NAMES) - {"one", "sampled", "mixed", "occurrences"}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_and_empty_tables(spark, labels, awkward, empty, name):
    run = runs_of(labels)[name]
    found = run(awkward).collect()
    if name in ONE_EACH:
        assert len(found) == len(AWKWARD)
    assert run(empty).collect() == []


def test_word_counts(spark, awkward):
    want = [len((t or "").encode().split()) for _, t, *_ in AWKWARD]
    assert [r[0] for r in awkward.select(n_words(F.col("text"))).collect()] == want


def test_ranks_follow_the_order(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 251).alias("x"), "id").repartition(5)
    got = sorted((r["rank"], r["x"], r["id"]) for r in with_rank(rows, [F.col("x"), F.col("id")]).collect())
    assert [r[0] for r in got] == list(range(500))
    assert [r[1:] for r in got] == sorted(r[1:] for r in got)


# 1


def test_rules_and_reputation(spark):
    urls = [
        "http://Foo.COM/x?y", "https://a.example.com/en/1", "https://www.example.com/en/#t", "http://b.net/es/", "http://b.net/espace",
        "http://bad.org/1", "http://one.bad2.org/", "http://good.org/2", None, "nourl", "http://x.com", "ftp://u://v/w",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    outcomes = spark.createDataFrame(
        [("bad.org", False)] * 60
        + [("good.org", True)] * 60
        + [(f"mixed{i}.org", g) for i in range(12) for g in [True] * 15 + [False] * 5]
        + [("one.bad2.org", False), ("good.org", None)],
        "host string, good boolean",
    )
    rules = [host_reputation.Rule(*x) for x in (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"))]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in host_reputation.judge(pages, outcomes, rules).collect()}
    assert got[0] == ("foo.com", "/x", "com/", "allow")
    assert got[1][2:] == ("example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block")
    assert got[4][2:] == (None, "allow")
    assert got[5][2:] == (None, "block")
    assert got[6][2:] == (None, "allow"), "one bad page proves little"
    assert got[7][2:] == (None, "allow")
    assert got[8][:2] == got[9][:2] == ("", "")
    assert got[10] == ("x.com", "", None, "allow"), "an empty path starts with no rule's path"
    assert got[11][:2] == ("u:", "//v/w")


def test_reputation_shrinks_with_few_labels(spark):
    rows = [("a.x.org", True)] * 40 + [("b.x.org", False)] * 2 + [("c.y.org", True)] * 38 + [("c.y.org", False)] * 2
    known = host_reputation.reputations(spark.createDataFrame(rows, "host string, good boolean"))
    mean = {r["host"]: r["mean"] for r in known["host"].collect()}
    assert 0 < mean["b.x.org"] < mean["a.x.org"] < 1
    none = spark.createDataFrame([], "host string, good boolean")
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert host_reputation.judge(pages, none).first()["verdict"] == "allow"


# 2


def plain_repeats(words):
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({i + k for i in range(len(words) - 2) for k in range(3) if seen[tuple(words[i : i + 3])] > 1})


def test_line_measures(docs):
    for _, text, *_ in [*sample(), *AWKWARD]:
        words = (text or "").encode().split()
        got = line_rules.measure(text)
        assert got[0] == len(words)
        assert got[1] == sum(len(w.decode()) for w in words)
        assert got[4] == (plain_repeats(words) if len(words) < 5000 else got[4])
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert got[3] == len(lines) - len(set(lines))


def test_lines_that_fail():
    good = "A sentence of plain words, with an end."
    for bad in ("Home | About | Contact | Legal", "All rights reserved.", "WORD!! WORD!! HERE!!", "a%% b$$ c&& d## e** f", "x " * 6):
        assert line_rules.line_fails(bad, bad.encode().split())
        text = "\n".join([good] * 3 + [bad])
        assert line_rules.measure(text, min_words=1, max_repeat=100)[-1] == "\n".join([good] * 3)
        assert not line_rules.measure("\n".join([bad] * 9 + [good]), min_words=1, max_repeat=100)[6]
    assert not line_rules.line_fails(good, good.encode().split())


# 3


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    lowest = defaultdict(list)
    for i, x in enumerate(ids):
        lowest[find(i)].append(x)
    return [min(lowest[find(i)]) for i in range(len(ids))]


def test_simhash_components(docs):
    want = sample()
    prints = [plain_fingerprint(t) for _, t, *_ in want]
    roots = plain_components([r[0] for r in want], prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {r[0]: (f"{p:016x}", c) for r, p, c in zip(want, prints, roots, strict=True)}
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(set(roots))


@pytest.mark.parametrize("bucket", [20, 128])
def test_near_pairs_are_complete(spark, bucket):
    rng = random.Random(4)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            prints.add(y)
    base = rng.getrandbits(64)
    prints |= {base ^ k for k in range(64)}  # a dense cloud in one posting
    rows = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp bigint")
    mask = (1 << 64) - 1
    got = {frozenset((a & mask, b & mask)) for a, b in simhash.near_pairs(rows, bucket=bucket).collect()}
    own = sorted(prints)
    assert got == {frozenset((a, b)) for i, a in enumerate(own) for b in own[:i] if (a ^ b).bit_count() <= 3}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in smallest_of_component(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


# 4


def test_byte_bpe_is_that_of_the_library(spark, awkward):
    rank_file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    whole = byte_bpe.encoding(rank_file, pattern)
    assert isinstance(whole, tiktoken.Encoding)
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", "é", " ", "  ", "\n", "'s", "12", "!?", "中", "\x85", "\u3000", "Wort"]) for _ in range(200))
        ids = byte_bpe.encode(text, rank_file, pattern, size=5)
        assert ids == whole.encode_ordinary(text)
        assert byte_bpe.decode(ids, rank_file, pattern) == text.encode()
    rows = byte_bpe.token_digests(awkward, rank_file, pattern).collect()
    for row, (_, text, *_) in zip(rows, AWKWARD, strict=True):
        ids = whole.encode_ordinary(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = byte_bpe.decoded(byte_bpe.encoded(awkward, rank_file, pattern), rank_file, pattern)
    assert [r["text"] for r in back.collect()] == [t or "" for _, t, *_ in AWKWARD]


# 5


def test_importance_tells_held_out_documents_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("pmod(doc_id, 2) = 0")
    got = importance.resample(docs, known).join(labels.where("pmod(doc_id, 2) = 1"), "doc_id").toPandas()
    good, bad = (got[got.quality == q].log_importance.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad).mean() > 0.9
    assert got[got.quality == 1].kept.mean() > 0.97
    again = importance.sampled_documents(docs, known)
    assert again.columns == docs.columns
    assert again.count() == importance.resample(docs, known).where("kept").count()


def test_kth_largest(spark):
    values = [float(x % 37) ** 3 for x in range(400)]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    for k in (1, 5, 200, 400):
        assert importance.kth_largest(rows, "x", k) == sorted(values, reverse=True)[k - 1]


# 6


def plain_seats(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@pytest.mark.parametrize("votes,to_give", [([3, 1, 2, 7, 0], 10), ([5, 5, 5], 4), ([1] * 9, 4), ([100, 1, 1], 7), ([1, 2, 3, 4, 5, 6], 1000), ([0, 0], 3)])
def test_seats_go_to_the_highest_quotients(spark, votes, to_give):
    rows = spark.createDataFrame([(0, i, float(v), to_give) for i, v in enumerate(votes)], "g int, i int, v double, s bigint")
    got = {r["i"]: r["seats"] for r in apportion.seats(rows, "g", "i", "v", "s").collect()}
    assert [got[i] for i in range(len(votes))] == (plain_seats(votes, to_give) if any(votes) else [0] * len(votes))


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else weight[s] * left / total for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a", "b", "b", "b", "b", "B", None, "z"]), 0) for i in range(900)]
    docs = spark.createDataFrame([*rows, rows[0], (901, "tiny", "en", "only", 4)], COLUMNS)
    got = apportion.mix(docs).drop("mark").collect()
    sizes = Counter()
    for _, t, _, s, _ in [*rows, rows[0], (901, "tiny", "en", "only", 4)]:
        sizes[s] += len(t.split())
    source = {r[0]: r[3] for r in rows} | {901: "only"}
    want = plain_targets(dict(sizes))
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * apportion.BLOCK_WORDS for s in want)
    assert sorted(map(str, got)) == sorted(map(str, apportion.mix(docs.repartition(7)).drop("mark").collect()))
    made = apportion.mixed_documents(docs)
    assert made.columns == docs.columns
    assert made.agg(F.sum(n_words(F.col("text")))).first()[0] == sum(taken.values())


# 7


def test_merkle(spark):
    rows = [(i, t) for i, t, *_ in sample()] + [(None, "no id\nat all"), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in merkle.edit_likeness(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]), reverse=True)
    prints = {}
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        row = got[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(text, set()).add(row["fingerprint"])
        prints.setdefault(edited, set()).add(row["edited_fingerprint"])
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if text == edited:
            assert row["near_edited"] == 1
    assert all(len(p) == 1 for p in prints.values())
    assert len(set.union(*prints.values())) == len(prints), "unlike texts have unlike fingerprints"


def test_merkle_parts_make_the_text(spark):
    texts = [t for _, t, *_ in sample()] + ["", "\n", "a\n\n\n b\n \n\nc", "no end mark " * 50, "a. b! c? d\n\n\ne. "]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", merkle.parts(F.col("text")).alias("p")).collect()
    for row in rows:
        assert "".join(s for ps in row["p"] for p in ps for s in p) == row["text"]


def test_merkle_finds_the_edit(spark):
    left = "One. Two.\nThree here.\n\nFour. Five.\nSix."
    pairs = spark.createDataFrame([(1, 2, left, left.replace("Five", "5")), (1, 3, left, left)], "a int, b int, left string, right string")
    assert [tuple(r) for r in merkle.differing_branches(pairs).collect()] == [(1, 2, 1, 0)]


def test_next_rows_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS_PER_SLICE", 7)
    rng = random.Random(5)
    ids = [rng.randint(0, 10**6) for _ in range(300)] + [10**15, None, 4, 4]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "doc_id bigint, _tie bigint")
    got = {r["_tie"]: r["next__tie"] for r in merkle.with_next(rows, ["_tie"]).collect()}
    order = [i for i, _ in sorted(enumerate(ids), key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=True)]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


# 8


def test_site_lines(spark):
    rows = [(i, f"menu\nown {i}\n\nrare {i % 7}", "h") for i in range(20)] + [(100 + i, "menu\nx", None) for i in range(3)] + [(300, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in site_lines.drop_boilerplate(docs, ratio=0.5).collect()}
    assert all(got[i] == (f"own {i}\n\nrare {i % 7}", 3, 1) for i in range(20))
    assert got[100] == ("menu\nx", 2, 0), "three pages are too few"
    assert got[300] == (None, 0, 0)


# 9


def test_patterns_in_linear_time_are_the_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "@", ".", "-", " ", "a.b", "+1", "@a.b", "9", "4111111111111111", "1.2.3.4"]) for _ in range(12))
        want = [(k, *m.span()) for k in KINDS for m in PATTERNS[k].finditer(text) if passes(k, m.group())]
        assert base_spans(text) == want


def test_gradient_of_the_tagger():
    rng = np.random.default_rng(0)
    tagger = Tagger.new(5, hidden=3)
    windows, tags = rng.integers(0, 16, (4, 7)), rng.integers(0, 5, (4, 7))
    _, grad = tagger.loss_and_gradient(windows, tags)
    for name, value in tagger.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        value[at] += 1e-5
        up, _ = tagger.loss_and_gradient(windows, tags)
        value[at] -= 2e-5
        down, _ = tagger.loss_and_gradient(windows, tags)
        value[at] += 1e-5
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-7)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    tagger = Tagger.new(3, hidden=2)
    tagger.p["trans"] = rng.normal(size=(3, 3))
    scores = rng.normal(size=(6, 3))
    paths = np.stack(np.meshgrid(*[range(3)] * 6), -1).reshape(-1, 6)
    value = scores[np.arange(6), paths].sum(1) + tagger.p["trans"][paths[:, :-1], paths[:, 1:]].sum(1)
    assert tagger.best_path(scores).tolist() == paths[value.argmax()].tolist()


def test_tagger_finds_held_out_spans(spark):
    rng = random.Random(7)

    def mail():
        return "".join(rng.choice("abcdefgh") for _ in range(6)) + f".{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com"

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    def words(most):
        return " ".join("".join(rng.choice("abcdeéfgh.,") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, most)))

    def text():
        return f"{words(9)} {mail()} {words(5)} {rng.randint(1, 99)} {words(5)} {phone()} {words(9)}"

    rows = [(i, text()) for i in range(600)]
    tagger = pii_tagger.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), steps=250)
    found = wanted = right = 0
    for _ in range(60):
        own = text()
        want = set(base_spans(own))
        items = [(0, own[a:b], a) for a, b in pii_tagger.stretches(own)]
        got = {(kind, a, b) for _, kind, a, b, _ in pii_tagger.tagged(items, tagger)}
        found, wanted, right = found + len(got), wanted + len(want), right + len(got & want)
    assert right / found > 0.9 and right / wanted > 0.9


def test_base_spans_stay_and_are_counted(spark):
    text = "mail a.b@c.org, 10.0.0.1 and 999.1.1.1, 4111 1111 1111 1111 or +1 (234) 555-1234"
    row = pii_tagger.find_personal_data(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), steps=2).first()
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(row["spans"].split(","))


def test_two_entries_side_by_side(spark):
    one, other, wrong = "4111111111111111", "5500005555555559", "4111111111111112"
    text = f"pay {one} {other} or {wrong}, call +1 (234) 555-1234 10.20.30.40 now"
    base = base_spans(text)
    assert [k for k, _, _ in base] == ["ip"]
    cards, phone = text.index(one), text.index("+1")
    found = [text[a:b] for a, b in pii_tagger.parts(text, "card", cards, cards + 33, base)]
    assert found == [one, other] and all(pii_tagger.plausible("card", x, 0.8, 0.7) for x in found)
    found = [text[a:b] for a, b in pii_tagger.parts(text, "phone", phone, phone + 29, base)]
    assert found == ["+1 (234) 555-1234"] and pii_tagger.plausible("phone", found[0], 0.8, 0.7)
    assert not pii_tagger.plausible("card", wrong, 1.0, 0.7)
    unclear = [text[a:b] for a, b in undecided(text)]
    assert unclear == [f"{one} {other}", wrong, "+1 (234) 555-1234 10.20.30.40"]


def test_tagger_adds_what_the_patterns_miss(spark):
    rng = random.Random(3)

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    def ip():
        return ".".join(str(rng.randint(10, 255)) for _ in range(4))

    rows = [(i, f"word {phone()} and so, there {ip()} it is {rng.randint(1, 99)}") for i in range(300)]
    rows += [(i, f"reach {phone()} {ip()} then") for i in range(300, 320)]
    out = pii_tagger.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    for row in out:
        base = base_spans(rows[row["doc_id"]][1])
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(row["spans"].split(","))
    beside = [row for row in out if row["doc_id"] >= 300]
    right = sum("phone:6:23" in row["spans"].split(",") for row in beside)
    assert right >= 15, right
    assert sum(row["n_added"] for row in out if row["doc_id"] < 300) == 0


# 10


def plain_removal(texts, least):
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + least] for b in data for i in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for i in range(len(b) - least + 1):
            if counts[b[i : i + least]] > 1:
                gone[i + 1 : i + 1 + least] = True
        own = gone[1 : len(b) + 1]
        kept = bytes(x for x, g in zip(b, own, strict=True) if not g)
        out.append((len(b), int(own.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeating_texts(seed=3):
    rng = random.Random(seed)
    words = ["ab", "ba", "aab", "xyz", "é", "q "]
    passages = ["".join(rng.choice(words) for _ in range(rng.randint(10, 40))) for _ in range(6)]
    texts = [None, "", "a" * 100, "a" * 60]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append("".join(rng.choice(words) for _ in range(rng.randint(0, 25))))
            if rng.random() < 0.7:
                parts.append(rng.choice(passages)[rng.randint(0, 10) :])
        texts.append("".join(parts))
    return texts + texts[10:14]


@pytest.mark.parametrize("members", [2, 2048])
def test_repeats_are_those_of_all_windows(spark, members):
    texts = repeating_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r[0]: tuple(r[1:5]) for r in repeats.remove_repeats(docs, 20, 6, members).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 20)


def test_repeats_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 50)
    repeats._powers.cache_clear()
    texts = repeating_texts(5)
    found = [list(repeats.runs((t or "").encode(), 20, 6)) for t in texts]
    repeats._powers.cache_clear()
    for text, own in zip(texts, found, strict=True):
        starts = [p + k for p, first, last, *_ in own for k in range(first, last + 1)]
        assert starts == list(range(max(0, len((text or "").encode()) - 19)))


def plain_passages(rows, least):
    """(n_passages, n_passage_bytes) of each (doc_id, text), by all windows."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - least + 1):
            holders[data[i : i + least]].add((doc_id, text))
    out = []
    for _, text in rows:
        data = (text or "").encode()
        held = np.zeros(len(data) + 2, dtype=bool)
        for i in range(len(data) - least + 1):
            if len(holders[data[i : i + least]]) > 1:
                held[i + 1 : i + 1 + least] = True
        out.append((int((np.diff(held.astype(int)) == 1).sum()), int(held.sum())))
    return out


@pytest.mark.parametrize("members", [2, 2048])
def test_shorter_passages_of_other_documents_are_counted(spark, members):
    texts = repeating_texts(7)
    rows = list(enumerate(texts)) + [(20, texts[20]), (None, texts[21]), (None, "q" * 90), (None, "q" * 90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = repeats.remove_repeats(docs, 45, 6, members, passage=20).drop("spans").collect()
    removed, passages = plain_removal([t for _, t in rows], 45), plain_passages(rows, 20)
    want = Counter((doc_id, *cut, *held) for (doc_id, _), cut, held in zip(rows, removed, passages, strict=True))
    assert Counter(map(tuple, got)) == want
    assert any(not cut[1] and held[0] for cut, held in zip(removed, passages, strict=True)), "passages too short to remove"
    assert any(cut[1] and not held[0] for cut, held in zip(removed, passages, strict=True)), "repeats inside one document"


def test_passage_below_the_removed_length_is_seen(spark):
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))

    passage = prose(60)[:300]
    texts = [f"{prose(80)} {passage} {prose(80)}", f"{prose(30)} {passage}", prose(200), f"{passage[:200]} {prose(50)}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(repeats.remove_repeats(docs, passage=256).collect())
    assert [r["n_removed"] for r in got] == [0, 0, 0, 0], "strings of 400 bytes only"
    assert [r["n_passages"] for r in got] == [1, 1, 0, 0]
    assert all(300 <= r["n_passage_bytes"] <= 303 for r in got[:2])


def test_runs_of_two_lengths_across_chunks(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 50)
    repeats._powers.cache_clear()
    texts = repeating_texts(5)
    found = [list(repeats.runs((t or "").encode(), 20, 6, 45)) for t in texts]
    repeats._powers.cache_clear()
    for text, own in zip(texts, found, strict=True):
        n = len((text or "").encode())
        places = [p for p, *_ in own]
        assert places == sorted(set(places)), "one run a place"
        for size in (20, 45):
            starts = {k for p, first, last, *_ in own for k in range(p + first, p + last + 20 - size + 1)}
            assert starts == set(range(max(0, n - size + 1)))


def test_maximal_repeats_of_an_anchor():
    texts = [b"xxabcANCHORdefyy", b"zzabcANCHORdefww", b"qqqbcANCHORdeg", b"no ANCHOR"]
    members = [(t, t.index(b"ANCHOR")) for t in texts]
    got = {(texts[own[0]][members[own[0]][1] - left : members[own[0]][1] + right], tuple(sorted(own))) for left, right, own in repeats.maximal_repeats(members, 6)}
    assert got == {(b"abcANCHORdef", (0, 1)), (b"bcANCHORde", (0, 1, 2)), (b"ANCHOR", (0, 1, 2, 3))}


def test_occurrences_hold_equal_bytes(spark):
    texts = repeating_texts(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    groups = defaultdict(set)
    places = defaultdict(set)
    for r in repeats.repeat_occurrences(docs, 20, 6).where("repeat >= 0").collect():
        groups[r["anchor"], r["repeat"]].add(texts[r["doc_id"]].encode()[r["start"] : r["end"]])
        places[r["anchor"], r["repeat"]].add((r["doc_id"], r["start"]))
    assert groups
    assert all(len(g) == 1 and len(next(iter(g))) >= 20 for g in groups.values())
    assert all(len(p) > 1 for p in places.values())
