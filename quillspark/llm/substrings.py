"""Removal of long byte strings that occur more than once, by suffix arrays.

Every byte that is covered by a ``LENGTH``-byte string which also starts elsewhere, in any
text or the same, is removed.

Where a string could repeat. Each LENGTH-byte window has an anchor: the ``GRAM``-byte gram
in it with the least hash, leftmost first. Equal windows have equal anchors at equal
offsets, so windows whose anchor's gram is nowhere else need no look. Windows that
share an anchor are neighbours; they and the bytes they cover are a context. Two equal
contexts repeat as a whole, and of several one stands for all.

Where it does repeat. Contexts that share a gram with different ones go to one shard, by
the gram. A shard's suffix array comes from Larsson-Sadakane refinement, common prefixes
from Kasai's algorithm, and window starts repeat if their neighbours share LENGTH bytes. A
gram with more than ``HOT`` contexts is split over shards of that size; each tells the
sorted digests of its distinct windows, packed by ranges of digests, and merging these
arrays by binary search finds windows that are single in their shard but not in all. A
shard's window is told once, so copies do not pile up in a range.

Cases: null and empty texts, and those shorter than LENGTH, keep all; very long texts are
dealt in parts that overlap by a window, so none is missed; every place of a repeated
string goes, the first as well; rows that repeat a doc_id with the same text are repeats of
each other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .suffix import common_prefixes, in_others, suffix_array

LENGTH, GRAM = 400, 64
WINDOW = LENGTH - GRAM + 1
#: Bytes looked at together, contexts of a gram in one shard, bytes of a shard.
SLAB, HOT, SHARD = 1 << 21, 512, 1 << 21
_POSITION = np.uint64((1 << 24) - 1)


def _powers() -> tuple[np.ndarray, list[tuple[int, np.uint64]]]:
    r = np.random.default_rng(5)
    base, out, k = int(r.integers(1 << 62)) * 4 + 3, [], 1
    while k < GRAM:
        out.append((k, np.uint64(pow(base, k, 1 << 64))))
        k *= 2
    return r.integers(0, 1 << 64, 256, dtype=np.uint64), out


_BYTES, _STEPS = _powers()


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """The hash of the gram at each position, from hashes of half its length, a quarter, ..."""
    h = _BYTES[buf]
    for k, p in _STEPS:
        h = h[:-k] * p + h[k:]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor's position for each window: the least of WINDOW hashes, leftmost first, by running minima over blocks."""
    n = len(h)
    key = (h & ~_POSITION) | np.arange(n, dtype=np.uint64)
    pad = -n % WINDOW
    key = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(key, axis=1).ravel()
    m = n - WINDOW + 1
    return (np.minimum(ahead[:m], behind[WINDOW - 1 : WINDOW - 1 + m]) & _POSITION).astype(np.int64)


def _runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, hash) of each context of the texts that lie at [start, end) in buf."""
    empty = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return empty, empty, empty, empty
    h = gram_hashes(buf)
    pos = anchors(h)
    step = np.zeros(len(pos) + 1, dtype=np.int32)
    some = end - start >= LENGTH
    np.add.at(step, start[some], 1)
    np.add.at(step, end[some] - LENGTH + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    new = valid & np.r_[True, ~valid[:-1] | (pos[1:] != pos[:-1])]
    last = valid & np.r_[~valid[1:] | (pos[1:] != pos[:-1]), True]
    s0, s1 = np.flatnonzero(new), np.flatnonzero(last)
    return s0, s1, pos[s0], h[pos[s0]].view(np.int64)


def _slabs(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, row, start, end): stretches of the bytes of a batch and the texts in each; a very long text is dealt in overlapping parts."""
    n, i = len(offsets) - 1, 0
    while i < n:
        a = int(offsets[i])
        if offsets[i + 1] - a > 2 * SLAB:
            for x in range(a, int(offsets[i + 1]) - LENGTH + 1, SLAB):
                y = min(x + SLAB + LENGTH - 1, int(offsets[i + 1]))
                yield x, y, np.array([i]), np.array([0]), np.array([y - x])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, a + SLAB, "right")) - 1)
        yield a, int(offsets[j]), np.arange(i, j), offsets[i:j] - a, offsets[i + 1 : j + 1] - a
        i = j


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, end to end, and where each begins."""
    col = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    col = pa.compute.fill_null(col, b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = _raw(b.column("text"))
        ids, th = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("th").to_numpy(zero_copy_only=False)
        for a, z, row, start, end in _slabs(off):
            buf = data[a:z]
            s0, s1, p, h = _runs(buf, start, end)
            if not len(s0):
                continue
            k = np.searchsorted(start, s0, "right") - 1
            while len(start) > 1 and (end[k] <= s0).any():  # empty texts share a start
                k = np.where(end[k] <= s0, k + 1, k)
            view, digest = memoryview(buf), xxhash.xxh3_64_intdigest
            c = np.array([digest(view[x:y]) for x, y in zip(s0.tolist(), (s1 + LENGTH).tolist(), strict=True)], dtype=np.uint64).view(np.int64)
            shift = a - off[row[k]]
            yield pa.record_batch(
                [pa.array(x) for x in (ids[row[k]], th[row[k]], s0 + shift, (s1 - s0).astype(np.int32), (p - s0).astype(np.int32), h, c)],
                names=["doc_id", "th", "s", "n", "o", "h", "c"],
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for, of each document."""
    for b in batches:
        out: list[tuple] = []
        for d, th, t, asked in zip(*(b.column(x).to_pylist() for x in ("doc_id", "th", "text", "asked")), strict=True):
            raw = t.encode()
            out += [(x["h"], x["salt"], x["parts"], d, th, x["s"], x["n"], x["single"], raw[x["s"] : x["s"] + x["n"] + LENGTH]) for x in asked]
        yield pa.record_batch([pa.array(list(x), k.type) for x, k in zip(zip(*out, strict=True) if out else [[]] * 9, _SHARDED, strict=True)], schema=_SHARDED)


_SHARDED = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("parts", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("single", pa.bool_()), ("ctx", pa.binary())])
_FOUND = "doc_id long, th long, a long, b long, bucket int, told binary"
_FOUND_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "th", "a", "b")), ("bucket", pa.int32()), ("told", pa.binary())])
#: A window that a shard tells others: digest, where it is, and whether it is single there.
_TOLD = np.dtype([("k", "<u8"), ("doc_id", "<i8"), ("th", "<i8"), ("s", "<i8"), ("lone", "?")])
#: Contexts whose windows are merged in one place.
TOGETHER = 4000


def _spans(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cutp = np.flatnonzero(np.diff(at) != 1)
    return at[np.r_[0, cutp + 1]], at[np.r_[cutp, len(at) - 1]]


def repeated_windows(rows: list[tuple]) -> tuple[list[tuple], np.ndarray]:
    """Of a shard's contexts (h, salt, parts, doc_id, th, s, n, single, ctx): runs of window starts that repeat, and what to tell other shards, in order of digest."""
    size = np.array([len(r[8]) for r in rows], dtype=np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    raw = b"".join(r[8] for r in rows)
    text = np.frombuffer(raw, dtype=np.uint8).astype(np.int64) + 1
    sa = suffix_array(text, np.repeat(ends, size))
    lcp = common_prefixes(text, starts, ends, sa)
    windows = np.array([r[6] for r in rows], dtype=np.int64) + 1
    own = np.repeat(np.arange(len(rows)), size)
    is_start = np.arange(len(text)) - starts[own] < windows[own]
    group = np.cumsum(lcp < LENGTH)[is_start[sa]]
    pos = sa[is_start[sa]]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    count = np.diff(np.r_[first, len(group)])
    flag = np.zeros(len(text), dtype=bool)
    flag[pos[np.repeat(count > 1, count)]] = True
    out: list[tuple] = []
    for i, r in enumerate(rows):
        if r[7]:  # a context that stands for several is a repeat by itself
            hit = np.flatnonzero(flag[starts[i] : starts[i] + windows[i]])
            if len(hit):
                out += [(r[3], r[4], r[5] + a, r[5] + b) for a, b in zip(*(x.tolist() for x in _spans(hit)), strict=True)]
    split = np.array([r[2] > 1 for r in rows])
    tell = split[own[pos[first]]]
    p, c = pos[first][tell], count[tell]
    told = np.zeros(len(p), dtype=_TOLD)
    told["k"] = [xxhash.xxh3_64_intdigest(raw[x : x + LENGTH]) for x in p.tolist()]
    for name, k in (("doc_id", 3), ("th", 4), ("s", 5)):
        told[name] = np.array([r[k] for r in rows], dtype=np.int64)[own[p]]
    told["s"] += p - starts[own[p]]
    told["lone"] = (c == 1) & np.array([r[7] for r in rows])[own[p]]
    return out, told[np.argsort(told["k"], kind="stable")]


def _found(runs: list[tuple], told: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each run, and one for each range of digests with all that is told of it."""
    edges = np.searchsorted(told["k"], np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64))
    packed = [(i, x.tobytes()) for i, x in enumerate(np.split(told, edges)) if len(x)]
    none = [None] * len(packed)
    cols = list(zip(*runs, strict=True)) if runs else [()] * 4
    return pa.record_batch(
        [*(pa.array([*c, *none], pa.int64()) for c in cols), pa.array([None] * len(runs) + [b for b, _ in packed], pa.int32()), pa.array([None] * len(runs) + [x for _, x in packed], pa.binary())],
        schema=_FOUND_ARROW,
    )


def _shards(buckets: int):
    """Whole grams (or parts of hot ones) are gathered until they fill a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(x).to_pylist() for x in _SHARDED.names), strict=True):
                if group and r[:2] != group[0][:2]:
                    rows += group
                    group = []
                    if size >= SHARD:
                        yield _found(*repeated_windows(rows), buckets)
                        rows, size = [], 0
                group.append(r)
                size += len(r[8])
        rows += group
        if rows:
            yield _found(*repeated_windows(rows), buckets)

    return run


def merged(arrays: list[np.ndarray]) -> list[tuple]:
    """Runs of windows that are single in their shard but told by another too: binary searches in the merged digests."""
    every = np.sort(np.concatenate([a["k"] for a in arrays]))
    out: list[tuple] = []
    for a in arrays:
        a = a[in_others(every, a["k"]) & a["lone"]]
        a = a[np.lexsort((a["s"], a["th"], a["doc_id"]))]
        new = np.r_[True, (a["doc_id"][1:] != a["doc_id"][:-1]) | (a["th"][1:] != a["th"][:-1]) | (np.diff(a["s"]) != 1)] if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(a)] - 1 if len(a) else first
        out += zip(a["doc_id"][first].tolist(), a["th"][first].tolist(), a["s"][first].tolist(), a["s"][last].tolist(), strict=True)
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of bucket; a bucket's arrays are merged together."""
    held: list[np.ndarray] = []
    at = None

    def batch() -> pa.RecordBatch:
        runs = merged(held)
        return pa.record_batch([pa.array(list(c), pa.int64()) for c in (zip(*runs, strict=True) if runs else [()] * 4)], names=["doc_id", "th", "a", "b"])

    for b in batches:
        for k, x in zip(b.column("bucket").to_pylist(), b.column("told").to_pylist(), strict=True):
            if k != at and held:
                yield batch()
                held = []
            at = k
            held.append(np.frombuffer(x, dtype=_TOLD))
    if held:
        yield batch()


def repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, th, a, b): first and last start of runs of windows that occur elsewhere too; th names the text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").where("octet_length(text) >= " + str(LENGTH))
    ctx = cut(docs.mapInArrow(_contexts, "doc_id long, th long, s long, n int, o int, h long, c long"))
    key = ["h", "c", "n", "o"]
    alike = ctx.groupBy(*key).agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    grams = alike.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("copies").alias("places")).where("places > 1").select("h", "kinds")
    met = ctx.join(alike.join(grams, "h"), key)
    met = cut(met.select("doc_id", "th", "s", "n", "o", "h", "c", "copies", "least", "kinds"))
    whole = met.where("copies > 1").select("doc_id", "th", F.col("s").alias("a"), (F.col("s") + F.col("n")).alias("b"))
    single = met.where("kinds > 1 and copies = 1")
    stand = met.where("kinds > 1 and copies > 1 and doc_id = least").dropDuplicates(key)
    parts = F.ceil(F.col("kinds") / HOT).cast("int")
    asked = single.withColumn("single", F.lit(True)).unionByName(stand.withColumn("single", F.lit(False)))
    asked = asked.withColumn("parts", parts).withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id, s), parts) as int)"))
    asked = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "salt", "parts", "s", "n", "single")).alias("asked"))
    # rows that are alike in doc_id and text ask alike, so one of them serves
    bytes_ = docs.join(asked, ["doc_id", "th"]).mapInArrow(_texts, "h long, salt int, parts int, doc_id long, th long, s long, n int, single boolean, ctx binary")
    hot = met.where((F.col("kinds") > HOT) & (F.col("copies") == 1)).count()
    found = cut(bytes_.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_shards(1 + hot // TOGETHER), _FOUND))
    across = found.where("told is not null").select("bucket", "told").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge, "doc_id long, th long, a long, b long")
    return whole.unionByName(found.where("told is null").select("doc_id", "th", "a", "b")).unionByName(across)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for d, t, runs in zip(*(b.column(x).to_pylist() for x in ("doc_id", "text", "runs")), strict=True):
            raw = (t or "").encode()
            spans: list[list[int]] = []
            for a, z in sorted((r["a"], r["b"] + LENGTH) for r in runs or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], z)
                else:
                    spans.append([a, z])
            at, kept = 0, []
            for a, z in spans:
                kept.append(raw[at:a])
                at = z
            kept.append(raw[at:])
            left = b"".join(kept)
            out.append((d, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"a": a, "b": z} for a, z in spans]))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def substring_dedup(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans [a, b) are the byte runs removed."""
    runs = repeats(documents).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>"
    return docs.join(runs, ["doc_id", "th"], "left").select("doc_id", "text", "runs").mapInArrow(_remove, schema)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("spans")
