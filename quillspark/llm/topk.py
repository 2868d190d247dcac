"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of ``LISTS`` partial scores, one for each slice of the dimensions.
Phase 1 gathers local lists: each block of ``ROWS`` rows scores one slice, the blocks
taking turns, and gives the full scores of the ``LEADERS`` first entries of that list; the
k-th best of all of them for a query is a safe cutoff t, which is broadcast. Phase 2
collects the entries that can still reach t: at least one partial score must be t / LISTS
or more, and the slices scored so far together with the greatest score that the last slice
could add (the product of the two lengths there) must come to t. Phase 3 adds the last
slice's partial scores for those entries only, exactly, and drops what stays below t. A
part raises its own cutoffs as it finds better entries and passes on its k best for a query,
so many equal vectors cost no more rows than k.

Queries are taken in blocks of about ``QUERY_BLOCK``, which bounds what is broadcast; each
block meets all rows. Scores are integers and exact while sums stay below 2^63.

Cases: vectors that are null, empty, or hold null or non-finite components take no part,
nor do rows without vec_id; vectors may be of any length, and those of unlike length have no
score; a row with the query's own vec_id is no candidate; repeated rows of a vec_id count as
one candidate each, and as one query if their vectors are equal, else as one query each;
fewer than k candidates give all; equal scores rank by smaller vec_id; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, EVERY, SCALE, LISTS, QUERY_BLOCK = 5, 50, 256, 4, 8192
#: Candidates scored at once; entries of a list that phase 1 scores in full.
ROWS, LEADERS = 256, 8
#: Below any score.
LOWEST = -(2**62)


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): v the integer components, of usable vectors."""
    ok = F.expr("embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return embeddings.where(ok).where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        flat, n = b.column("v").flatten().to_numpy(zero_copy_only=False), b.num_rows
        ids, v = b.column("vec_id").to_numpy(zero_copy_only=False), flat.reshape(n, dim)
        for i in range(0, n, ROWS):
            yield ids[i : i + ROWS], v[i : i + ROWS]


def slices(dim: int) -> list[np.ndarray]:
    """The dimensions of each list."""
    return np.array_split(np.arange(dim), min(LISTS, dim))


def partial(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A slice's scores, queries by candidates."""
    # sums below 2^53 are exact in floating point
    small = v.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) < 2**52
    return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if small else q @ v.T


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def leaders(v: np.ndarray, q: np.ndarray, turn: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1 for a block: (query, candidate, full score) of the first entries of the list whose turn it is."""
    d = slices(v.shape[1])[turn % min(LISTS, v.shape[1])]
    p = partial(v[:, d], q[:, d])
    top = np.argpartition(-p, min(count, p.shape[1]) - 1, axis=1)[:, :count]
    qi, ci = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
    return qi, ci, np.einsum("ij,ij->i", q[qi], v[ci])


def collect(v: np.ndarray, q: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 for a block: (query, candidate, full score) of every entry that can reach its query's cutoff."""
    *some, last = slices(v.shape[1])
    # t / LISTS rounded up: an entry below it in every list sums to less than t
    share = np.where(low > LOWEST, -(-low // (len(some) + 1)), LOWEST)[:, None]
    # a little over the product of lengths, so that rounding loses nothing
    most = np.outer(_length(q[:, last]), _length(v[:, last])) * (1 + 1e-9) + 1
    enough, total = most >= share, np.zeros((len(q), len(v)), np.int64)
    for d in some:
        p = partial(v[:, d], q[:, d])
        enough |= p >= share
        total += p
    qi, ci = np.nonzero(enough & (total + most >= low[:, None]))
    return qi, ci, total[qi, ci] + np.einsum("ij,ij->i", q[qi][:, last], v[ci][:, last])


def _best(qi: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: by score, then smaller id."""
    o = np.lexsort((ids, -s, qi))
    qi, ids, s = qi[o], ids[o], s[o]
    first = np.r_[True, qi[1:] != qi[:-1]] if len(qi) else np.zeros(0, bool)
    rank = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0)) if len(qi) else np.zeros(0, int)
    keep = rank < k
    return qi[keep], ids[keep], s[keep]


def _part(shared, k: int, dim: int, cutoffs: bool):
    """Phase 1 without cutoffs, phases 2 and 3 with them: (q, vec_id, score) of what a part passes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, low = shared.value
        held = [np.zeros(0, np.int64)] * 3
        for turn, (ids, v) in enumerate(_blocks(batches, dim)):
            qi, ci, s = collect(v, q, low) if cutoffs else leaders(v, q, turn, max(k, LEADERS) + 1)
            keep = qid[qi] != ids[ci]
            if cutoffs:
                keep &= s >= low[qi]
            held = list(_best(*(np.concatenate([a, b]) for a, b in zip(held, (qi[keep], ids[ci[keep]], s[keep]), strict=True)), k))
            if cutoffs:  # those of whom k are held by now need more than the k-th of them
                n = np.bincount(held[0], minlength=len(q))
                ends = np.cumsum(n)[n == k] - 1
                low = low.copy()
                low[held[0][ends]] = np.maximum(low[held[0][ends]], held[2][ends])
        yield pa.record_batch([pa.array(x.astype(np.int64)) for x in held], names=["q", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, v) rows; every query meets every row."""
    spark, sc = vectors.sparkSession, vectors.sparkSession.sparkContext
    queries = queries.distinct()
    out = None
    schema = "q long, vec_id long, score long"
    for dim in [r.d for r in queries.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]:
        mine, rows = queries.where(F.size("v") == dim), vectors.where(F.size("v") == dim)
        blocks = max(1, -(-mine.count() // QUERY_BLOCK))
        for block in range(blocks):
            got = mine.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id", "v").toPandas()
            if got.empty:
                continue
            qid, q = got.vec_id.to_numpy(), np.stack([np.asarray(x, dtype=np.int64) for x in got.v])
            lists = rows.mapInArrow(_part(sc.broadcast((qid, q, None)), k, dim, False), schema)
            low = np.full(len(qid), LOWEST, dtype=np.int64)
            nth = lists.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") == k)
            for r in nth.select("q", "score").collect():  # one number for each query of the block
                low[r.q] = r.score
            sure = rows.mapInArrow(_part(sc.broadcast((qid, q, low)), k, dim, True), schema)
            names = spark.createDataFrame(list(enumerate(qid.tolist())), "q long, query_id long")
            found = sure.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
            found = found.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP3_SQL = f"""
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, q.v, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) score
  FROM (SELECT DISTINCT * FROM ok WHERE vec_id % {EVERY} = 0) q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= {K}
"""
