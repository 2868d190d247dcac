"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``BITS`` differing bits are linked. The 64 bits are grouped into
partitions (bits that go together share one, as such a group tells fewer documents apart
than its width says, and can then be given a lower threshold or none), and partition i
gets a threshold e_i with sum(e_i + 1) = BITS + 1: of two linked fingerprints one
partition's parts differ in e_i bits at most. The thresholds, and whether to use two or
three partitions, come from a dynamic program over estimated candidate counts: exact
collision counts of each partition, and the bits' shares for those one or two bits off.
Buckets of the chosen parts are probed and their pairs compared in full.

Equal fingerprints are one class and are never paired. In a bucket whose pairs would
exceed ``PAIRS``, members meet at the fingerprints one flip away instead: two are within
two bits exactly if they share one, so the links are the same and the rows are 65 a
member, not a number that grows with the square.

Cases: null, empty and wordless texts have fingerprint zero and are linked with each
other; doc_id is taken to name a document; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .graph import components

#: Words in a shingle, hash seed, most differing bits.
WORDS, SEED, BITS = 3, 42, 2
#: Pairs of a bucket beyond which its members meet through their neighbours.
PAIRS = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint: each bit is set if more than half of the shingles' hashes have it."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < WORDS else map(b" ".join, zip(*(w[i:] for i in range(WORDS)), strict=False))
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.record_batch([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_prints, "doc_id long, fp long")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = np.zeros((64, 64), dtype=np.int64)
    for b in batches:
        fp = np.ascontiguousarray(b.column("fp").to_numpy(zero_copy_only=False))
        x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        m += (x.T @ x).astype(np.int64)
    i, j = np.nonzero(m)
    yield pa.record_batch([pa.array(i), pa.array(j), pa.array(m[i, j])], names=["i", "j", "n"])


def _groups(m: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of like size: each begins with the bit left over that is least tied, and takes those most tied to it."""
    p = m.diagonal() / n
    cov = m / n - np.outer(p, p)
    r = np.abs(cov) / np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    left, out = set(range(64)), []
    for k in range(parts, 0, -1):
        size = len(left) // k
        g = [max(left, key=lambda b: (sum(r[b, x] for x in left), -b))]
        left -= {g[0]}
        while len(g) < size:
            b = max(left, key=lambda b: (sum(r[b, x] for x in g), -b))
            g.append(b)
            left.discard(b)
        out.append(sorted(g))
    return out


def _mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def _costs(pairs: float, n: int, bits: list[int], p: np.ndarray) -> list[float]:
    """Probes and candidates at thresholds -1, 0, 1, 2."""
    odds = (2 * p * (1 - p) / np.maximum(p * p + (1 - p) ** 2, 1e-9))[bits]
    s1 = odds.sum()
    s2 = (s1 * s1 - (odds * odds).sum()) / 2
    w = len(bits)
    near = max(pairs, n * n / 2 / 2.0 ** min(w, 60))
    return [0.0, n + pairs, n * (1 + w) + near * (1 + s1), n * (1 + w + w * (w - 1) / 2) + near * (1 + s1 + s2)]


def _thresholds(costs: list[list[float]]) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(e + 1) = BITS + 1, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (v, es) in best.items():
            for e in range(-1, BITS + 1):
                u = used + e + 1
                if u <= BITS + 1 and (u not in step or v + c[e + 1] < step[u][0]):
                    step[u] = (v + c[e + 1], [*es, e])
        best = step
    return best[BITS + 1]


def plan(classes: DataFrame) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition used, from counts over all classes; 4,096 counts and five sums come to the driver."""
    n = classes.count()
    if n < 2:
        return [(g, 0) for g in _groups(np.eye(64) * 0.5, 1, BITS + 1)]
    m = np.zeros((64, 64))
    for r in classes.select("fp").mapInArrow(_together, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        m[r.i, r.j] = r.n
    p = m.diagonal() / n
    options = [_groups(m, n, k) for k in (2, 3)]
    every = [g for o in options for g in o]
    keys = F.array(*(F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(_mask(g))).alias("key")) for i, g in enumerate(every)))
    hit = classes.select(F.explode(keys).alias("x")).groupBy("x.g", "x.key").agg(F.count("*").cast("double").alias("c")).groupBy("g").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs"))
    pairs = {r.g: r.pairs for r in hit.collect()}
    found, at = [], 0
    for o in options:
        costs = [_costs(pairs.get(at + i, 0.0), n, g, p) for i, g in enumerate(o)]
        at += len(o)
        v, es = _thresholds(costs)
        found.append((v, [(g, e) for g, e in zip(o, es, strict=True) if e >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _flips(bits: list[int], e: int) -> list[int]:
    """What turns a part into each of those at most e bits off."""
    out = [0]
    if e >= 1:
        out += [_mask([b]) for b in bits]
    if e >= 2:
        out += [_mask([a, b]) for i, a in enumerate(bits) for b in bits[:i]]
    return out


def links(classes: DataFrame) -> DataFrame:
    """(u, v): links between the classes (fp, rep) that connect all within BITS bits of each other."""
    parts = plan(classes)
    index, probe = [], []
    for i, (bits, e) in enumerate(parts):
        key = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        index.append(F.struct(F.lit(i).alias("p"), key.alias("key"), F.lit(True).alias("own")))
        probe += [F.struct(F.lit(i).alias("p"), key.bitwiseXOR(F.lit(x)).alias("key"), F.lit(False).alias("own")) for x in _flips(bits, e) if x]
    rows = classes.select("fp", "rep", F.explode(F.array(*index, *probe)).alias("x")).select("fp", "rep", "x.*")
    size = rows.groupBy("p", "key").agg(F.count_if("own").alias("ni"), F.count("*").alias("nq")).where("ni > 0 and nq > 1")
    met = rows.join(size, ["p", "key"])
    few = met.where(F.col("ni") * F.col("nq") <= PAIRS)
    a = few.where("own").select("p", "key", F.col("fp").alias("fa"), F.col("rep").alias("u"))
    b = few.select("p", "key", F.col("fp").alias("fb"), F.col("rep").alias("v"))
    pairs = a.join(b, ["p", "key"]).where((F.col("u") != F.col("v")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= BITS)).select("u", "v")
    many = met.where(F.col("ni") * F.col("nq") > PAIRS).select("fp", "rep").distinct()
    middle = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(64)))
    spread = many.select("rep", F.explode(middle).alias("mid"))
    star = spread.groupBy("mid").agg(F.min("rep").alias("u"), F.count("*").alias("n")).where("n > 1").select("mid", "u")
    around = spread.join(star, "mid").where("rep <> u").select("u", F.col("rep").alias("v"))
    return pairs.unionByName(around).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): fp signed; component_id is the least doc_id reachable by links."""
    prints = cut(fingerprints(documents))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(classes))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
