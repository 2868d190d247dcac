"""Near copies for the pipeline: texts that share four fifths or more of their five-word shingles.

64 bits of SimHash cannot tell at this distance: at Jaccard 0.8 some ten bits differ, and a
radius that wide leaves the pigeonhole parts of three or four bits. Candidates come from
MinHash instead, in ``BANDS`` bands of ``ROWS`` values (a pair at 0.8 meets in none with
probability (1 - 0.8 ** ROWS) ** BANDS, under 1 in 10,000; above 0.8 less often). Pairs that
meet are dropped if their numbers of shingles already forbid 0.8, and else checked exactly,
by the Jaccard similarity of the two sets of shingles' hashes. op2's links (three words, two
bits) are kept beside these, so wordless texts are linked with each other.

A bucket's texts are linked where they lie together, by components: a text is compared only
with those not yet linked to it, until all are of one component or all have been compared,
and what comes out is a link for each union, not for each pair. So no two texts that share a
bucket and are near stay unlinked, and rows follow the number of texts, not of pairs. Buckets
of the same texts are looked at once. One of over ``BLOCK`` texts is dealt in blocks, each
with the bucket's centre (the text that has the most mates, as the text has that others were
copied from; then least doc_id and hash). What the blocks have linked, over all buckets, is
then one component, and each hot bucket is looked at again: its largest component in blocks,
each with all texts of the others, of which blocks are as large as these are many. Only if
over ``LARGE`` texts are in the others, each two blocks of ``LARGE`` meet, so that a task's
memory has a bound: then a text is dealt once for each block.

Cases: texts, by their hash, are what is linked, so a doc_id listed with two texts has each
judged by itself; fewer than five words are one shingle; very long texts are taken whole;
case and white space count as for op2; an empty table has no copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut
from .graph import components

#: Words in a shingle, the least similarity of a near copy.
WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
#: Texts of a hot bucket that are linked together, and the most unlinked ones that each block of it may hold.
BLOCK, LARGE = 512, 8192
_SIDE = np.random.default_rng(42).integers(0, 1 << 63, size=(2, BANDS * ROWS + WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    w = (text or "").encode().translate(simhash._LOWER).split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, w), dtype=np.uint64, count=len(w))
    k = min(WORDS, len(w))
    x = reduce(np.add, (h[i : len(h) - k + 1 + i] * _SIDE[0, -1 - i] for i in range(k)))
    x = (x ^ (x >> np.uint64(31))) * _SIDE[1, -1]
    return np.unique(x ^ (x >> np.uint64(29)))


def bands(x: np.ndarray) -> list[int]:
    """A signed key for each band of the shingles' least hashes; a text without shingles has none."""
    if not len(x):
        return []
    a, b = _SIDE[0, : BANDS * ROWS, None], _SIDE[1, : BANDS * ROWS, None]
    least = reduce(np.minimum, (((x[i : i + 1024] ^ b) * a).min(axis=1) for i in range(0, len(x), 1024))).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(v.tobytes(), i) for i, v in enumerate(least)], dtype=np.uint64).view(np.int64).tolist()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            c = b.slice(i, 256)
            texts = c.column("text").to_pylist()
            fp = np.array([simhash.fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            sets = [shingles(t) for t in texts]
            keys = pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch([c.column("doc_id"), c.column("th"), pa.array(fp), pa.array([len(x) for x in sets], pa.int32()), keys], names=["doc_id", "th", "fp", "n", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            c = b.slice(i, 64)
            sets = pa.array([shingles(t).tobytes() for t in c.column("text").to_pylist()], pa.binary())
            yield pa.record_batch([c.column("th"), sets], names=["th", "s"])


def _unions(th: list[int], group: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect all near texts, beside what ``group`` has connected already; the first text is compared first."""
    n, size = len(th), np.array([len(x) for x in sets])
    root = np.unique(group, return_inverse=True)[1]
    start = np.r_[0, np.cumsum(size)]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    who = np.repeat(np.arange(n), size)[np.argsort(ids, kind="stable")]
    often = np.bincount(ids)
    first = np.r_[0, np.cumsum(often)]
    holders = lambda some: np.concatenate([who[first[i] : first[i + 1]] for i in some])
    percent, to_do, x = round(LEAST * 100), np.ones(n, dtype=bool), 0
    while True:
        to_do[x] = False
        other = to_do & (root != root[x])
        own = ids[start[x] : start[x + 1]]
        # a near text lacks a fifth of these at most, so it holds one of any few more; the rarest are asked for
        few = len(own) + 1 + (-percent * len(own)) // 100
        if other.any() and other[holders(own[np.argsort(often[own])[:few]])].any():
            shared = np.bincount(holders(own), minlength=n)
            # by whole numbers, so that a similarity of just LEAST counts
            near = np.flatnonzero(other & (shared * 100 >= percent * (size + len(own) - shared)))
            joined, at = np.unique(root[near], return_index=True)
            for y in near[at]:
                yield th[x], th[y]
            root[np.isin(root, joined)] = root[x]
        # a pair is done with either of its texts, so the components with the fewest come first, and the last may be left
        left = np.bincount(root[to_do], minlength=n)
        if np.count_nonzero(left) < 2:
            return
        x = int(np.flatnonzero(to_do & (root == np.where(left, left, n + 1).argmin()))[0])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each (key, part); rows of one are together, its centre first."""
    rows = ((k, r) for b in batches for k, r in zip(zip(b.column("key").to_pylist(), b.column("part").to_pylist(), strict=True), zip(b.column("th").to_pylist(), b.column("g").to_pylist(), b.column("s"), strict=True), strict=True))
    for _, group in groupby(rows, key=lambda x: x[0]):
        th, g, s = zip(*(r for _, r in group), strict=True)
        if found := list(_unions(th, g, [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in s])):
            u, v = zip(*found, strict=True)
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _within(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links between the texts of each (key, part)."""
    rows = dealt.select("key", "part", "first", "th", "g").join(sets, "th")
    return cut(rows.repartition("key", "part").sortWithinPartitions("key", "part", F.desc("first")).select("key", "part", "th", "g", "s").mapInArrow(_linked, "u long, v long").distinct())


def jaccard_links(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): hashes of near texts, which connect all that share a bucket. docs has (doc_id, th, text), texts (th, rep, n, keys), once a text."""
    rows = texts.select("rep", "th", "n", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("th")).alias("x"), F.bit_xor(F.xxhash64("th", F.lit(1))).alias("y"), F.min("n").alias("least"), F.max("n").alias("most"))
    buckets = buckets.where((F.col("k") > 2) | (F.col("k") == 2) & (F.col("least") * 100 >= F.col("most") * round(LEAST * 100)))
    # as the planner does not know these keys, it deals their sums anew, and AQE can split a hot key of the joins
    once = buckets.groupBy("k", "x", "y").agg(F.min("key").alias("key")).select(F.col("key").bitwiseXOR(F.lit(0)).alias("key"), "k")
    met = cut(rows.join(once, "key").select("key", "k", "rep", "th"))
    some = met.select("rep", F.col("th").alias("at")).distinct()
    sets = cut(docs.join(some, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("at")), "left_semi").dropDuplicates(["doc_id", "th"]).select("th", "text").mapInArrow(_sets, "th long, s binary"))
    hash_ = F.xxhash64("th", "key")
    dealt = met.select("key", F.pmod(hash_, F.ceil(F.col("k") / BLOCK)).alias("part"), F.lit(False).alias("first"), "th", F.col("th").alias("g"))
    hot = met.where(F.col("k") > BLOCK)
    if hot.isEmpty():
        return _within(dealt, sets)
    mates = met.groupBy("th").agg(F.sum(1 - F.col("k")).alias("fewer"))
    centres = hot.join(mates, "th").groupBy("key", "k").agg(F.min(F.struct("fewer", "rep", "th")).alias("c"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("k") / BLOCK) - 1))
    near = _within(dealt.unionByName(centres.select("key", parts.alias("part"), F.lit(True).alias("first"), F.col("c.th").alias("th"), F.col("c.th").alias("g"))), sets)
    named = cut(hot.join(components(near), F.col("th") == F.col("node"), "left").select("key", "k", "th", F.coalesce("component", "th").alias("g")))
    main = named.groupBy("key", "k", "g").agg(F.count("*").alias("size")).groupBy("key", "k").agg(F.max(F.struct("size", "g")).alias("m"))
    open_ = main.where("m.size < k").select(F.col("key").bitwiseXOR(F.lit(0)).alias("key"), F.col("m.g").alias("main"), "m.size")
    rest = F.col("k") - F.col("size")
    blocks = F.greatest(F.lit(1), F.floor(F.col("size") / F.greatest(rest, F.lit(BLOCK))))
    to_all = F.when(F.col("g") == F.col("main"), F.array(F.pmod(hash_, blocks))).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1))
    many = F.ceil(F.col("k") / LARGE)
    in_pairs = F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda i: F.least(i, F.pmod(hash_, many)) * many + F.greatest(i, F.pmod(hash_, many)))
    again = named.join(open_, "key").select("key", F.explode(F.when(rest <= LARGE, to_all).otherwise(in_pairs)).alias("part"), F.lit(False).alias("first"), "th", "g")
    return near.unionByName(_within(again, sets))


def others(documents: DataFrame) -> DataFrame:
    """(doc_id, th) of what is to go: all of a group of linked texts but its least doc_id with its least hash."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    prints = cut(docs.mapInArrow(_sketches, "doc_id long, th long, fp long, n int, keys array<long>"))
    texts = cut(prints.groupBy("th").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("fp", "n", "keys"))))
    classes = cut(texts.groupBy("fp").agg(F.min("th").alias("rep")))
    same = texts.select("fp", F.col("th").alias("u")).join(classes, "fp").select("u", F.col("rep").alias("v")).where("u <> v")
    links = same.unionByName(simhash.links(classes)).unionByName(jaccard_links(docs, texts.select("th", "rep", "n", "keys")))
    named = cut(texts.join(components(links), F.col("th") == F.col("node"), "left").select("rep", "th", F.coalesce("component", "th").alias("g")))
    least = named.groupBy("g").agg(F.min(F.struct("rep", "th")).alias("x"))
    keep = named.join(least, "g").select("th", "x")
    return prints.select("doc_id", "th").join(keep, "th").where((F.col("doc_id") != F.col("x.rep")) | (F.col("th") != F.col("x.th"))).select("doc_id", "th").distinct()
