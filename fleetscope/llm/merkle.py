"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A section ends with a blank line, a paragraph with its newline, and a sentence with white
space behind an end mark, a bar or a colon, or after MOST characters; every character
belongs to one sentence, so the parts concatenate to the text. Leaves are 64-bit hashes of
sentences, a paragraph hashes its leaves, a section its paragraphs and the root its
sections: equal texts have equal roots, and where roots differ only differing branches need
to be followed to the edit.

The fingerprint is the tree in text: root:section/paragraph,paragraph;section/... with
leaves in brackets. Two fingerprints are alike by twice their common leaves over all leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import checkpointed

#: Characters of a sentence without an end mark, at most.
MOST = 120
SECTION = r"(?<=\n[ \t\r]{0,8}\n)(?![ \t\r]*\n)"
PARAGRAPH = r"(?<=\n)"
SENTENCE = r"(?s).{1,%d}?(?:(?<=[.!?…:;|。！？])\s|$)|.{1,%d}" % (MOST, MOST)
ROWS_PER_SLICE = 1000
PARTS = 256


def parts(text: Column) -> Column:
    """The text as sections of paragraphs of sentences; the empty text has one of each."""
    paragraphs = F.transform(F.split(text, SECTION, -1), lambda s: F.split(s, PARAGRAPH, -1))
    return F.transform(
        paragraphs, lambda ps: F.transform(ps, lambda p: F.regexp_extract_all(p, F.lit(SENTENCE), F.lit(0)))
    )


def leaves(text: Column) -> Column:
    """Nested hashes of the sentences."""
    return F.transform(parts(text), lambda ps: F.transform(ps, lambda p: F.transform(p, lambda s: F.xxhash64(s))))


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def fingerprint(tree: Column) -> Column:
    """Root, then sections with their paragraphs' hashes and leaves, as one string."""
    body = F.array_join(
        F.transform(
            tree,
            lambda ps: F.concat(
                _hex(F.xxhash64(F.transform(ps, lambda p: F.xxhash64(p)))),
                F.lit("/"),
                F.array_join(
                    F.transform(
                        ps,
                        lambda p: F.concat(
                            _hex(F.xxhash64(p)), F.lit("("), F.array_join(F.transform(p, _hex), ","), F.lit(")")
                        ),
                    ),
                    ",",
                ),
            ),
        ),
        ";",
    )
    return F.concat(root(tree), F.lit(":"), body)


def root(tree: Column) -> Column:
    sections = F.transform(tree, lambda ps: F.xxhash64(F.transform(ps, lambda p: F.xxhash64(p))))
    return F.md5(F.array_join(F.transform(sections, _hex), ","))


def likeness(a: Column, b: Column) -> Column:
    """2 |common| / (|a| + |b|) of two arrays of distinct leaves, 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def own_leaves(tree: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(tree)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with root and fingerprint; a null text counts as empty, repeated rows stay."""
    tree = leaves(F.coalesce("text", F.lit("")))
    own = [F.col(c) for c in docs.columns if c not in ("root", "fingerprint")]
    held = docs.select(*own, tree.alias("_tree"))
    return held.select(*own, root(F.col("_tree")).alias("root"), fingerprint(F.col("_tree")).alias("fingerprint"))


def differing_branches(pairs: DataFrame) -> DataFrame:
    """(a, b, section, paragraph) where the trees of the texts left and right differ.

    pairs has a, b and the texts. Places count from 0; a branch that only one tree has
    differs. Pairs of equal texts give no row.
    """
    trees = pairs.select(
        "a", "b", leaves(F.coalesce("left", F.lit(""))).alias("x"), leaves(F.coalesce("right", F.lit(""))).alias("y")
    ).where(root(F.col("x")) != root(F.col("y")))
    sections = trees.select(
        "a", "b", F.posexplode(F.arrays_zip("x", "y")).alias("section", "s")
    ).where(~F.col("s.x").eqNullSafe(F.col("s.y")))
    none = F.array().cast("array<array<bigint>>")
    return (
        sections.withColumn("x", F.coalesce("s.x", none))
        .withColumn("y", F.coalesce("s.y", none))
        .select("a", "b", "section", F.posexplode(F.arrays_zip("x", "y")).alias("paragraph", "p"))
        .where(~F.col("p.x").eqNullSafe(F.col("p.y")))
        .select("a", "b", "section", "paragraph")
    )


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, _tie, columns) with next_<column> of the following row.

    Rows follow each other by descending doc_id (null last), then by _tie; the first row
    follows the last. Rows are dealt into slices of about ROWS_PER_SLICE by quantiles of the
    id and even steps between them, at most 100,000 slices; the head of each slice is also
    sent to the slice before it, so each text is shuffled once and no task sees more than
    its slices.
    """
    first, last, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if not n:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    slices = max(1, min(n // ROWS_PER_SLICE, 100_000))
    shares = [i / PARTS for i in range(1, PARTS)] if slices > PARTS else [i / slices for i in range(1, slices)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or [])) if shares else []
    lows, highs = [first, *cuts], [*cuts, last]
    steps = max(1, slices // max(1, len(lows)))
    bounds = F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in zip(lows, highs, strict=True)])
    part = F.aggregate(
        F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), F.lit(0), lambda k, c: k + (F.col("doc_id") >= c).cast("int")
    )
    rows = docs.withColumn("_part", F.when(F.col("doc_id").isNull(), -1).otherwise(part))
    bound = F.get(bounds, "_part")
    width = (bound["high"] - bound["low"]).cast("double") / steps + 1
    step = F.when(F.col("_part") < 0, 0).otherwise(F.floor((F.col("doc_id") - bound["low"]) / width))
    rows = rows.withColumn("_slice", (F.col("_part") * (steps + 1) + step).cast("long")).drop("_part")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.col("_tie").alias("tie"))
    heads = rows.groupBy("_slice").agg(F.max(key).alias("_head"))
    before = F.lag("_slice").over(Window.orderBy(F.col("_slice").desc()))
    final = F.first("_slice").over(Window.orderBy(F.col("_slice")))
    heads = checkpointed(heads.select("_slice", "_head", F.coalesce(before, final).alias("_before"), before.isNull().alias("_wraps")))
    # at most 100,000 rows of a few numbers
    rows = rows.join(F.broadcast(heads), "_slice")
    places = F.when(
        key.eqNullSafe(F.col("_head")),
        F.array(
            F.struct(F.col("_slice").alias("at"), F.lit(0).alias("guest")),
            F.struct(F.col("_before").alias("at"), F.when(F.col("_wraps"), 2).otherwise(1).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("_slice").alias("at"), F.lit(0).alias("guest"))))
    rows = rows.withColumn("_p", F.explode(places)).drop("_slice", "_head", "_before", "_wraps")
    inside = Window.partitionBy("_p.at").orderBy("_p.guest", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc())
    following = [F.lead(c).over(inside).alias(f"next_{c}") for c in columns]
    return rows.select("*", *following).where("_p.guest = 0").drop("_p")


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many of the next document's (with_next), or by all it has. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited (to the edited text) and
    near_next (to the next document), one row for each row of docs (doc_id, text). A null
    text counts as empty; one document is its own next.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie"))
    rows = rows.withColumn("_tree", leaves(F.col("text")))
    rows = with_next(rows, ["text", "_tree"])
    half = F.floor(F.length("text") / 2).cast("int")
    stays = F.length("text") - half
    edited = F.concat(F.substring("text", F.lit(1), stays), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "_tree", "next__tree")
    rows = rows.withColumn("_edited", leaves(F.col("edited")))
    own, other, next_ = (own_leaves(F.col(c)) for c in ("_tree", "_edited", "next__tree"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("_tree")).alias("fingerprint"),
        fingerprint(F.col("_edited")).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, next_).alias("near_next"),
    )
