"""Character n-grams counted and looked up where the text is, so that no row for each n-gram of a document is shuffled."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a task buffers before it sorts them, n-grams that it holds before it passes them on, numbers of a model's block, characters looked up at once.
BUFFER, HELD, BLOCK, AT_ONCE = 1 << 21, 1 << 20, 1 << 22, 1 << 18
_POINTS, _POINT_BITS = 0x110000, 21


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, how often each is there), the values in order."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[at], np.diff(np.r_[at, len(keys)])


class Counts:
    """How often n-grams stand in the texts of groups, and in how many texts of each.

    An n-gram is one integer: its characters' numbers in the order in which they were met,
    from 1. Where these numbers, or what is held, would become too many, all is passed on.
    """

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi, self.bits = lo, hi, 62 // hi
        self._clear()

    def _clear(self) -> None:
        self.number, self.points = np.zeros(_POINTS, dtype=np.int32), np.zeros(1, dtype=np.uint32)
        self.buffered, self.size, self.totals = {}, 0, {}

    def add(self, group: tuple, text: str) -> Iterator[tuple[tuple, list[str], np.ndarray, np.ndarray]]:
        """Counts a text; what is passed on, if anything."""
        c = codes(text)
        new = np.unique(c[self.number[c] == 0])
        if len(self.points) + len(new) > 1 << self.bits:
            yield from self.flush()
            new = np.unique(c)
            if len(new) >= 1 << self.bits:
                raise ValueError(f"a text has {len(new)} characters that differ, which n-grams of {self.hi} can't number")
        if len(new):
            self.number[new] = np.arange(len(self.points), len(self.points) + len(new))
            self.points = np.r_[self.points, new]
        x, keys, parts = self.number[c].astype(np.int64), None, []
        for n in range(1, self.hi + 1):
            if len(x) < n:
                break
            keys = x if n == 1 else (keys[:-1] << self.bits) | x[n - 1 :]
            if n >= self.lo:
                parts.append(keys)
        if not parts:
            return
        keys = np.sort(np.concatenate(parts))
        places, once = self.buffered.setdefault(group, ([], []))
        places.append(keys)
        once.append(keys[np.r_[True, keys[1:] != keys[:-1]]])
        self.size += len(keys)
        if self.size > BUFFER:
            self._reduce()
            if sum(len(k) for k, _, _ in self.totals.values()) > HELD:
                yield from self.flush()

    def _reduce(self) -> None:
        for group, (places, once) in self.buffered.items():
            keys, c = _runs(np.concatenate(places))
            df = _runs(np.concatenate(once))[1]
            if group in self.totals:
                k0, c0, d0 = self.totals[group]
                keys, c, df = np.r_[k0, keys], np.r_[c0, c], np.r_[d0, df]
                order = np.argsort(keys, kind="stable")
                keys, c, df = keys[order], c[order], df[order]
                at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, c, df = keys[at], np.add.reduceat(c, at), np.add.reduceat(df, at)
            self.totals[group] = keys, c, df
        self.buffered, self.size = {}, 0

    def _strings(self, keys: np.ndarray) -> list[str]:
        """The n-grams of sorted keys, of which longer ones are greater."""
        out = []
        for n in range(self.lo, self.hi + 1):
            some = keys[np.searchsorted(keys, 1 << self.bits * (n - 1)) : np.searchsorted(keys, 1 << self.bits * n)]
            points = np.stack([self.points[(some >> self.bits * (n - 1 - i)) & ((1 << self.bits) - 1)] for i in range(n)], axis=1)
            joined = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            out += [joined[i : i + n] for i in range(0, len(joined), n)]
        return out

    def flush(self) -> Iterator[tuple[tuple, list[str], np.ndarray, np.ndarray]]:
        self._reduce()
        for group, (keys, c, df) in self.totals.items():
            for s in range(0, len(keys), 1 << 16):
                yield group, self._strings(keys[s : s + (1 << 16)]), c[s : s + (1 << 16)], df[s : s + (1 << 16)]
        self._clear()


def totals(texts: DataFrame, by: list[str], lo: int, hi: int) -> DataFrame:
    """(gram, by..., c, df): how often each n-gram stands in the texts (by..., t) of each group, and in how many of them."""
    rows = texts.select(*by, "t")
    types = [pa.string() if (k := rows.schema[c].dataType.simpleString()) == "string" else {"int": pa.int32(), "bigint": pa.int64()}[k] for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(lo, hi)

        def out(found: Iterable) -> Iterator[pa.RecordBatch]:
            for group, grams, c, df in found:
                keys = [pa.array([x] * len(grams), t) for x, t in zip(group, types, strict=True)]
                yield pa.record_batch([pa.array(grams, pa.string()), *keys, pa.array(c.astype(np.int64)), pa.array(df.astype(np.int64))], names=["gram", *by, "c", "df"])

        for b in batches:
            groups = list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * b.num_rows
            for i, group in enumerate(groups):
                yield from out(counts.add(group, b.column(len(by))[i].as_py()))
        yield from out(counts.flush())

    schema = ", ".join(["gram string", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), "c long", "df long"])
    return rows.mapInArrow(run, schema).groupBy("gram", *by).agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


class Trie:
    """The numbers of given n-grams in texts: a node for each of their beginnings, found by its parent and its last character."""

    def __init__(self, grams: list[str]):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.array([len(g) for g in grams])
        at, parent = np.arange(len(grams)), np.zeros(len(grams), dtype=np.int64)
        flat, starts = codes("".join(grams)).astype(np.int64), np.cumsum(np.r_[0, size])[:-1].astype(np.int64)
        for n in range(1, (size.max() if len(size) else 0) + 1):
            long = size[at] >= n
            at, parent = at[long], parent[long]
            keys, parent = np.unique((parent << _POINT_BITS) | flat[starts[at] + n - 1], return_inverse=True)
            row, ends = np.full(len(keys), -1, dtype=np.int64), size[at] == n
            row[parent[ends]] = at[ends]
            self.levels.append((keys, row))

    def find(self, c: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, numbers) of the n-grams of each length. c: characters; left: how many of its text are left at each, itself included."""
        at, node = np.arange(len(c)), np.zeros(len(c), dtype=np.int64)
        for n, (keys, row) in enumerate(self.levels, 1):
            some = left[at] >= n
            at = at[some]
            want = (node[some] << _POINT_BITS) | c[at + n - 1]
            node = np.searchsorted(keys, want)
            node[node == len(keys)] = 0
            known = keys[node] == want
            at, node = at[known], node[known]
            hit = row[node] >= 0
            yield at[hit], row[node[hit]]


def score(texts: DataFrame, keys: list[str], model: DataFrame, folds: list, labels: list[str], lo: int, fold: str | None = None) -> DataFrame:
    """(keys..., m, s): of each text (keys..., t) that has an n-gram the number of its known ones and, label by label, the sum of their weights.

    model: (f, gram, e) with e an array of (number of the label, weight), for each of the folds
    that ``fold`` names in a text. It meets the texts in blocks of n-grams of at most BLOCK
    weights, which bounds what is broadcast.
    """
    sc, rows = texts.sparkSession.sparkContext, texts.select(*keys, "t")
    model = model.persist()
    each = len(folds) * len(labels)
    blocks = max(1, -(-model.select("gram").distinct().count() * each // BLOCK))
    place, out = {f: i for i, f in enumerate(folds)}, None
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "m long", "s array<double>"])
    for block in range(blocks):
        some = model.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == block).select("f", "gram", F.transform("e", lambda x: x["l"]).alias("l"), F.transform("e", lambda x: x["d"]).alias("d")).toArrow().combine_chunks()
        grams = some["gram"].combine_chunks().dictionary_encode() if some.num_rows else pa.array([], pa.string()).dictionary_encode()
        grams = grams.combine_chunks() if isinstance(grams, pa.ChunkedArray) else grams
        at = np.asarray(grams.indices)
        f = np.array([place[x] for x in some["f"].to_pylist()], dtype=np.int64)
        weights, known = np.zeros((len(folds), len(labels), len(grams.dictionary))), np.zeros((len(folds), len(grams.dictionary)), dtype=bool)
        known[f, at] = True
        n = np.asarray(some["l"].combine_chunks().value_lengths()) if some.num_rows else np.zeros(0, dtype=np.int64)
        if some.num_rows:
            weights[np.repeat(f, n), np.asarray(some["l"].combine_chunks().flatten()), np.repeat(at, n)] = np.asarray(some["d"].combine_chunks().flatten())
        shared = sc.broadcast((Trie(grams.dictionary.to_pylist()), weights, known))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie, weights, known = shared.value
            for b in batches:
                texts = [codes(x) for x in b.column(len(keys)).to_pylist()]
                which = np.array([place[x] for x in b.column(keys.index(fold)).to_pylist()], dtype=np.int64) if fold else np.zeros(len(texts), dtype=np.int64)
                size = np.array([len(x) for x in texts], dtype=np.int64)
                ends, s = np.cumsum(size), 0
                while s < len(texts):
                    e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + AT_ONCE, "right")))
                    own = np.repeat(np.arange(e - s), size[s:e])
                    left = np.repeat(np.cumsum(size[s:e]), size[s:e]) - np.arange(len(own))
                    m, sums = np.zeros(e - s), np.zeros((len(labels), e - s))
                    for at, gram in trie.find(np.concatenate(texts[s:e]).astype(np.int64), left):
                        doc = own[at]
                        of = which[s:e][doc]
                        m += np.bincount(doc, weights=known[of, gram], minlength=e - s)
                        for i in range(len(labels)):
                            sums[i] += np.bincount(doc, weights=weights[of, i, gram], minlength=e - s)
                    has = np.flatnonzero(size[s:e] >= lo)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * len(labels), pa.int32()), pa.array(sums.T[has].ravel()))
                    yield pa.record_batch([*(b.column(i).take(pa.array(s + has)) for i in range(len(keys))), pa.array(m[has].astype(np.int64)), lists], names=[*keys, "m", "s"])
                    s = e

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    model.unpersist()
    return out.groupBy(*keys).agg(F.sum("m").alias("m"), F.array(*(F.sum(F.col("s")[i]) for i in range(len(labels)))).alias("s"))
