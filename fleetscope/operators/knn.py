"""Nearest neighbours by cosine distance.

Exact search streams the corpus past blocks of queries:

* equal corpus vectors are cut to their ``k`` smallest ids and equal queries are
  searched once, so a mass of copies costs one vector on either side;
* queries are dealt into salts of bounded size. A task holds the queries of one
  salt and their ``k`` nearest so far, and reads the entries one batch at a time,
  so the corpus is shuffled once per salt and ``k`` rows per query come out;
* entries come in the order of their nearest of a fixed number of pivots. A batch
  is met only by queries that may have one of their ``k`` nearest in the ball around it
  (triangle inequality on unit vectors, as in PGBJ, Lu et al., VLDB 2012);
* cosines of a batch are taken in single precision. Pairs that may be among the ``k`` nearest,
  given its error, are measured in double precision.

No task ever holds more than one salt of queries and one batch of entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK_ROWS = 8_192
#: Values (rows x dimensions) of the queries of one salt, and the fewest rows for which a further salt is worth its copy of the corpus.
QUERY_VALUES = 2_097_152
QUERY_ROWS = 2_048
#: Salts up to which few queries are spread for the sake of parallel tasks.
SPREAD = 8
#: Queries and entries whose cosines are held at once.
TILE = 1_024
MAX_PIVOTS = 64
DISTANCE_DIGITS = 12


def _stack(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


class _Nearest:
    """The queries of one block with their ``k`` nearest entries so far, ties by id."""

    def __init__(self, ids: list[np.ndarray], vectors: list[np.ndarray], k: int):
        self.ids, self.unit, self.k = np.concatenate(ids), _unit(np.concatenate(vectors)), k
        self.single = self.unit.astype("float32")
        n = len(self.ids)
        self.entry: np.ndarray | None = None
        self.distance = np.full((n, k), np.inf)
        self.filled = np.zeros(n, dtype="int64")
        # Most that a cosine in single precision is off.
        self.margin = (self.unit.shape[1] + 8) * 2.0**-23

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        unit = _unit(vectors)
        single = unit.astype("float32")
        if self.entry is None:
            self.entry = np.zeros((len(self.ids), self.k), dtype=ids.dtype)
        elif self.entry.dtype != ids.dtype:
            self.entry = self.entry.astype(np.result_type(self.entry, ids))
        centre = _unit(unit.mean(axis=0, keepdims=True))[0]
        radius = np.linalg.norm(unit - centre, axis=1).max()
        for low in range(0, len(self.ids), TILE):
            at = np.arange(low, min(low + TILE, len(self.ids)))
            worst = np.where(self.filled[at] < self.k, np.inf, self.distance[at, -1])
            to_centre = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * self.unit[at] @ centre))
            far = to_centre - radius > np.sqrt(np.maximum(0.0, 2.0 * worst)) + 1e-5
            at, worst = at[~far], worst[~far]
            if len(at):
                self._compare(at, worst, ids, unit, single)

    def _compare(self, at: np.ndarray, worst: np.ndarray, ids: np.ndarray, unit: np.ndarray, single: np.ndarray) -> None:
        cosine = self.single[at] @ single.T
        least = 1.0 - worst - self.margin - 10.0**-DISTANCE_DIGITS
        if not np.isfinite(worst).all() and len(ids) > self.k:
            among = np.partition(cosine, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            least = np.fmax(least, among - 2 * self.margin - 10.0**-DISTANCE_DIGITS)
        # Below is false for what is no number, so that such pairs come last instead of never.
        q, e = np.divmod(np.flatnonzero(~(cosine < least.astype("float32")[:, None])), len(ids))
        if not len(q):
            return
        dot = np.concatenate([np.einsum("nd,nd->n", self.unit[at[q[i : i + 65_536]]], unit[e[i : i + 65_536]]) for i in range(0, len(q), 65_536)])
        rows, inverse = np.unique(at[q], return_inverse=True)
        had, place = np.nonzero(np.arange(self.k)[None, :] < self.filled[rows][:, None])
        row = np.concatenate([had, inverse])
        distance = np.concatenate([self.distance[rows[had], place], np.round(1.0 - dot, DISTANCE_DIGITS)])
        entry = np.concatenate([self.entry[rows[had], place], ids[e]])
        order = np.lexsort((entry, distance, row))
        row, distance, entry = row[order], distance[order], entry[order]
        starts = np.searchsorted(row, np.arange(len(rows)))
        rank = np.arange(len(row)) - starts[row]
        best = rank < self.k
        self.distance[rows[row[best]], rank[best]], self.entry[rows[row[best]], rank[best]] = distance[best], entry[best]
        self.filled[rows] = np.minimum(np.bincount(row, minlength=len(rows)), self.k)

    def found(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.entry is None:
            return
        for low in range(0, len(self.ids), 65_536):
            q, place = np.nonzero(np.arange(self.k)[None, :] < self.filled[low : low + 65_536][:, None])
            q += low
            columns = (self.ids[q], self.entry[q, place], self.distance[q, place])
            made = [pa.array(c, type=f.type, from_pandas=f.name != "distance") for c, f in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(made, schema=schema)


def _has_direction(column: str) -> Column:
    return F.exists(F.col(column), lambda x: x != 0)


def _prepared(corpus: DataFrame, queries: DataFrame, k: int, match: Sequence[str]):
    """Corpus with at most ``k`` copies of a vector, one representative per query vector, and the map back."""
    digest = F.xxhash64("embedding")
    rank = F.row_number().over(Window.partitionBy(*match, "_h", "embedding").orderBy("entry_id"))
    entries = (
        corpus.select("entry_id", "embedding", *match)
        .where(_has_direction("embedding"))
        .withColumn("_h", digest)
        .withColumn("_rn", rank)
        .where(F.col("_rn") <= k)
        .drop("_rn", "_h")
    )
    asked = queries.select("query_id", "embedding", *match).where(_has_direction("embedding")).withColumn("_h", digest)
    reps = asked.groupBy(*match, "_h", "embedding").agg(F.min("query_id").alias("rep"))
    mapping = asked.join(reps, [*match, "_h", "embedding"]).select("query_id", "rep")
    return entries, reps.select(F.col("rep").alias("query_id"), "embedding", *match), mapping


def _search_blocks(
    entries: DataFrame, asked: DataFrame, k: int, blocks: Sequence[str], salts: Column | int, order: Sequence[str] = ()
) -> DataFrame:
    """Search of the asked queries among the entries of equal ``blocks``, which are read in the given order.

    The queries of a block are dealt to ``salts`` (a number, or one for each block from its number of queries ``_n``),
    and the entries of the block copied for each of them.
    """
    keys = [*blocks, "_salt"]
    if isinstance(salts, int):
        dealt = asked.withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
        copied = entries.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    else:
        sizes = asked.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n")).withColumn("_salts", salts).drop("_n")
        dealt = asked.join(sizes, list(blocks)).withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.col("_salts")).cast("int"))
        copied = entries.join(sizes, list(blocks)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    # Both sides may derive from one table: fresh aliases keep their columns apart.
    told = lambda df, kind, ids, *more: df.select(*[F.col(c).alias(c) for c in (*keys, *more, ids, "embedding")], F.lit(kind).alias("_kind"))
    rows = told(dealt, 0, "query_id").unionByName(told(copied, 1, "entry_id", *order), allowMissingColumns=True)
    spread = rows.repartition(*keys) if blocks else rows.repartitionById(salts, F.col("_salt"))
    sent = spread.sortWithinPartitions(*keys, "_kind", *order).select(*keys, "_kind", "query_id", "entry_id", "embedding")
    kinds = dict(sent.dtypes)
    out = f"query_id {kinds['query_id']}, entry_id {kinds['entry_id']}, distance double"
    made = to_arrow_schema(T._parse_datatype_string(out))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        nearest: _Nearest | None = None
        for batch in batches:
            columns = [batch.column(c) for c in (*keys, "_kind")]
            codes = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in columns]
            change = np.any([c[1:] != c[:-1] for c in codes], axis=0)
            edges = np.r_[0, np.flatnonzero(change) + 1, batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:]):
                if start == end:
                    continue
                *own, kind = (c[int(start)].as_py() for c in columns)
                if key != tuple(own):
                    if nearest is not None:
                        yield from nearest.found(made)
                    key, ids, vectors, nearest = tuple(own), [], [], None
                part = batch.slice(start, end - start)
                values = _matrix(part.column("embedding"))
                if kind == 0:
                    ids.append(_ids(part.column("query_id")))
                    vectors.append(values)
                elif ids:
                    nearest = nearest or _Nearest(ids, vectors, k)
                    for low in range(0, len(values), CHUNK_ROWS):
                        nearest.meet(_ids(part.column("entry_id"))[low : low + CHUNK_ROWS], values[low : low + CHUNK_ROWS])
        if nearest is not None:
            yield from nearest.found(made)

    return sent.mapInArrow(search, out)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _ranked(found: DataFrame, mapping: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "entry_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (
        mapping.join(best.withColumnRenamed("query_id", "rep"), "rep")
        .select("query_id", "entry_id", "distance", F.col("rank").cast("bigint").alias("rank"))
    )


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    where: Column | None = None,
    match_on: Sequence[str] = (),
    pivots: int | None = None,
) -> DataFrame:
    """Exact ``k`` nearest entries per query: (query_id, entry_id, distance, rank).

    ``queries`` has (query_id, embedding), ``corpus`` (entry_id, embedding); ``where`` filters
    the corpus before the search and ``match_on`` names columns that must be equal on both sides.
    Rows whose vector has no direction take no part.
    """
    match = list(match_on)
    corpus = corpus.where(where) if where is not None else corpus
    entries, asked, mapping = _prepared(corpus, queries, k, match)
    # Sizes before removing copies are upper bounds and come from file footers where nothing filters.
    n_queries = queries.count()
    rows = _salt_rows(asked)
    if match:
        return _ranked(_search_blocks(entries, asked, k, match, F.ceil(F.col("_n") / rows).cast("int")), mapping, k)
    salts = max(-(-n_queries // rows), min(SPREAD, -(-n_queries // QUERY_ROWS)), 1)
    wanted = pivots or min(MAX_PIVOTS, max(1, corpus.count() // CHUNK_ROWS))
    if wanted == 1:
        return _ranked(_search_blocks(entries, asked, k, [], salts), mapping, k)

    # A fixed number of pivot vectors, the first in hash order: bounded whatever the corpus size.
    anchors = _unit(_stack(r[0] for r in entries.orderBy(F.xxhash64("entry_id")).select("embedding").limit(wanted).collect()))

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series((_unit(_stack(vectors)) @ anchors.T).argmax(axis=1).astype("int32"))

    assigned = entries.withColumn("_cell", nearest("embedding"))
    return _ranked(_search_blocks(assigned, asked, k, [], salts, ["_cell"]), mapping, k)


def _salt_rows(asked: DataFrame) -> int:
    """Queries of one salt, by the dimensions of the first."""
    first = asked.select(F.size("embedding")).head()
    return max(1, QUERY_VALUES // max(1, first[0])) if first is not None else QUERY_ROWS


def knn_lsh(
    queries: DataFrame, corpus: DataFrame, k: int, dims: int, tables: int = 24, bits: int = 4, seed: int = 5
) -> DataFrame:
    """Approximate neighbours: only entries sharing a random-hyperplane bucket are compared.

    Every candidate of a bucket is compared, in the same bounded blocks as the exact search; a bucket is copied only
    where its own queries need more than one block, so each vector is shuffled once a table.
    The default tables and bits are those whose recall is tested on the provided vectors.
    """
    entries, asked, mapping = _prepared(corpus, queries, k, [])
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dims))
    weights = 1 << np.arange(bits)

    @F.pandas_udf("array<struct<table:int,bucket:int>>")
    def buckets(vectors: pd.Series) -> pd.Series:
        sides = np.einsum("nd,tbd->ntb", _stack(vectors), planes) > 0
        codes = (sides * weights).sum(axis=2)
        return pd.Series([[(t, int(c)) for t, c in enumerate(row)] for row in codes])

    spread = lambda df: df.withColumn("_b", F.explode(buckets("embedding"))).select(
        *df.columns, F.col("_b.table").alias("_table"), F.col("_b.bucket").alias("_cell")
    )
    salts = F.ceil(F.col("_n") / F.lit(max(1, QUERY_VALUES // dims))).cast("int")
    found = _search_blocks(spread(entries), spread(asked), k, ["_table", "_cell"], salts)
    once = found.groupBy("query_id", "entry_id").agg(F.min("distance").alias("distance"))
    return _ranked(once, mapping, k)


def lsh_recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact neighbours the approximate search found."""
    hit = approximate.select("query_id", "entry_id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["query_id", "entry_id"], "left").agg(
        F.count(F.lit(1)).alias("neighbours"), F.count("_hit").alias("found")
    )


def knn_graph(items: DataFrame, k: int) -> DataFrame:
    """Undirected neighbour edges (a < b) with their distance. (item_id, embedding)."""
    queries = items.select(F.col("item_id").alias("query_id"), "embedding")
    corpus = items.select(F.col("item_id").alias("entry_id"), "embedding")
    near = knn(queries, corpus, k + 1).where(F.col("query_id") != F.col("entry_id"))
    order = Window.partitionBy("query_id").orderBy("rank")
    kept = near.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
    return kept.groupBy(
        F.least("query_id", "entry_id").alias("a"), F.greatest("query_id", "entry_id").alias("b")
    ).agg(F.min("distance").alias("distance"))


def graph_degree(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.explode(F.array("a", "b")).alias("item_id"))
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def embed_distinct(rows: DataFrame, text: str, embed) -> DataFrame:
    """Embed each distinct text once and join the vector back; ``embed`` is a column function."""
    digest = F.sha2(F.col(text), 256)
    unique = rows.select(digest.alias("_d"), F.col(text).alias("_t")).dropDuplicates(["_d"])
    vectors = unique.select("_d", embed(F.col("_t")).alias("embedding"))
    return rows.withColumn("_d", digest).join(vectors, "_d").drop("_d")
