"""The operators against brute force, on the small tables and on fixtures of edge cases."""

import gc
import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quillspark.llm import decontaminate, htmltext, linededup, packing, quality, sharding, simhash, substrings, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and a column whose name the operators use themselves."""
    line = "Ein langer Satz mit vielen Worten, der sich wiederholt und mehr als fünfzig Zeichen hat."
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, LONG), (5, "one two"), (5, "one two"), (6, "x"), (7, f"{line}\n{line[::-1]}\nEnd 7\nTail 7"), (8, f"{line}\n{line[::-1]}\nother"), (9, LONG), (10, "\n\n\n")]
    rows += [(100 + i, f"{line}\n{line[::-1]}\n{line[5:]}\n{line[9:]}\nrow {i}") for i in range(20)]
    return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), 1, 2, "b") for d, t in rows], DOCS + ", h long, n int, b string")


def rows(df):
    return df.toPandas()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_print(t):
    w = words(t)
    if not w:
        return 0
    g = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    first = {}
    for d, f in zip(ids, prints, strict=True):
        first[f] = min(first.get(f, d), d)
    fs = list(first)
    up = {f: f for f in fs}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= 2:
                up[top(a)] = top(b)
    least = defaultdict(lambda: 1 << 62)
    for f in fs:
        least[top(f)] = min(least[top(f)], first[f])
    return [least[top(f)] for f in prints]


@pytest.mark.parametrize("which", ["table", "odd"])
def test_simhash(spark, medium, odd, which):
    docs = spark.read.parquet(f"{medium}/documents.parquet") if which == "table" else odd
    src = rows(docs.select("doc_id", "text"))
    got = rows(simhash.near_duplicates(docs))
    assert len(got) == len(src)
    prints = [brute_print(t) for t in src.text]
    want = sorted(zip(src.doc_id, prints, brute_components(src.doc_id, prints), strict=True))
    assert sorted((d, f % (1 << 64), c) for d, f, c in got.itertuples(index=False)) == want


@pytest.mark.parametrize("pairs", [simhash.PAIRS, 0])
def test_simhash_hot_bucket(spark, pairs, monkeypatch):
    """Fingerprints that walk away bit by bit, in small buckets and in those too large for pairs."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(300)}
    f = r.getrandbits(64)
    for _ in range(200):
        f ^= 1 << r.randrange(64)
        if r.random() < 0.5:
            f ^= 1 << r.randrange(64)
        prints.add(f)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    found = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == brute_components(range(len(prints)), prints)


def test_simhash_thresholds():
    assert simhash._thresholds([[0, 1, 5, 9]] * 3)[1] == [0, 0, 0]
    assert simhash._thresholds([[0, 1, 2, 9], [0, 50, 60, 70], [0, 2, 9, 9]])[1] == [1, -1, 0]


def brute_spans(texts, n):
    at = defaultdict(list)
    for i, t in enumerate(texts):
        for j in range(len(t) - n + 1):
            at[t[j : j + n]].append((i, j))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in at.values():
        if len(places) > 1:
            for i, j in places:
                gone[i][j : j + n] = True
    return gone


@pytest.mark.parametrize("hot", [substrings.HOT, 3])
@pytest.mark.parametrize("which", ["table", "odd", "made"])
def test_substrings(spark, small, odd, which, hot, monkeypatch):
    if which == "made":
        r = random.Random(1)
        base = "".join(r.choice("abcdé \n") for _ in range(3000))
        t = [base[r.randrange(0, 1500) : r.randrange(1500, 3000)] + "".join(r.choice("xyz ") for _ in range(r.randrange(300))) for _ in range(60)]
        t += ["ab" * 700, "q" * 399, "q" * 400, "q" * 401, "z" * 1000, base[:399], base[5:405]]
        docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    else:
        docs = spark.read.parquet(f"{small}/documents.parquet") if which == "table" else odd
    # a module constant does not reach the workers' shards, but the plan on the driver uses it
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "TOGETHER", 5)
    src = rows(docs.select("doc_id", "text"))
    raw = [(t or "").encode() for t in src.text]
    want = []
    for d, t, g in zip(src.doc_id, raw, brute_spans(raw, 400), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~g])
        want.append((d, len(t), int(g.sum()), int((np.diff(np.r_[0, g.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = rows(substrings.substring_dedup(docs).drop("spans"))
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)


def test_suffix_array_and_prefixes():
    from quillspark.llm.suffix import common_prefixes, suffix_array

    r = random.Random(2)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 80))) for _ in range(40)] + [b"aaaaaaaaaaaaaaaaaaaaaaaaa", b"ab" * 30, b"ab" * 30]
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    text = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    sa = suffix_array(text, np.repeat(ends, ends - starts))
    suffix = {s + k: t[k:] for s, t in zip(starts, texts, strict=True) for k in range(len(t))}
    assert list(sa) == sorted(suffix, key=lambda p: (suffix[p], p))
    lcp = common_prefixes(text, starts, ends, sa)
    for k in range(1, len(sa)):
        a, b = suffix[sa[k - 1]], suffix[sa[k]]
        assert lcp[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_topk_matches_sql(spark, small):
    got = rows(topk.op3_topk(spark, small))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    want = c.execute(topk.OP3_SQL).df()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def test_topk_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [1.0, 2.0, 3.0])]
    data += [(10 + i, [1.0, 1.0]) for i in range(9)]
    v = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = rows(topk.top_k(v, v.where("vec_id % 50 = 0")))
    assert list(got[got.query_id == 0].sort_values("rank").vec_id) == [10, 11, 12, 13, 14]
    assert set(got[got.query_id == 50].vec_id) == {10, 11, 12, 13, 14}
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_topk_odd_rows(spark):
    """Repeated vec_ids with equal and unlike vectors, very long vectors, further columns, and no vec_id: as the SQL has it."""
    r = np.random.default_rng(3)
    data = [(i, r.standard_normal(3).tolist(), 1) for i in range(100)] + [(0, [0.1, 0.2, 0.3], 2), (50, [0.5, 0.5, 0.5], 3), (50, [0.5, 0.5, 0.5], 4), (7, [1.0, 1.0, 1.0], 5), (None, [1.0, 1.0, 1.0], 6)]
    data += [(1000 + i, r.standard_normal(5000).tolist(), 1) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score int")
    v = topk.quantised(df)
    got = rows(topk.top_k(v, v.where("vec_id % 50 = 0")))
    c = duckdb.connect()
    embeddings = df.toPandas()  # noqa: F841
    assert sorted(got.itertuples(index=False, name=None)) == sorted(c.execute(topk.OP3_SQL).df().itertuples(index=False, name=None))


def test_topk_sums_few_pairs(medium):
    """Most pairs are dropped before their last slice is scored, and none that belongs to the best."""
    v = np.floor(np.stack(pd.read_parquet(f"{medium}/embeddings.parquet").embedding) * 256.0).astype(np.int64)
    q = v[::50]
    every = q @ v.T
    first = [topk.leaders(v[i : i + topk.ROWS], q, n, topk.LEADERS) for n, i in enumerate(range(0, len(v), topk.ROWS))]
    low = np.array([sorted(np.concatenate([s[qi == k] for qi, _, s in first]))[-topk.K] for k in range(len(q))])
    assert all((low[k] <= np.sort(every[k])[-topk.K]) for k in range(len(q)))
    qi, ci, s = topk.collect(v, q, low)
    assert (every[qi, ci] == s).all() and len(qi) < 0.6 * every.size
    assert {(a, b) for a, b in zip(qi.tolist(), ci.tolist(), strict=True)} >= {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(every >= low[:, None])), strict=True)}
    # with the cutoffs that a part reaches in the end, few are left
    qi, _, _ = topk.collect(v, q, np.sort(every, axis=1)[:, -topk.K])
    assert len(qi) < 0.3 * every.size


def test_packing(spark, medium, odd):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (spark.read.parquet(f"{medium}/documents.parquet"), odd):
        src = rows(docs.select("doc_id", "text"))
        got = rows(packing.pack(docs))
        ids = [[*e.ids, 1] for e in tok.encode_batch([t or "" for t in src.text], add_special_tokens=False)]
        want = []
        for d, x in zip(src.doc_id, ids, strict=True):
            at = 0
            for k in packing.lengths(len(x)):
                want.append((d, at, k, zlib.crc32(np.array(x[at : at + k], "<u4").tobytes()), len(x)))
                at += k
            assert at == len(x)
        assert sorted(got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == sorted(want)
        assert sorted(got.sequence_id) == list(range(len(got))) and (got.offset == 0).all()
        assert got.length.map(lambda n: n & (n - 1) == 0 and n <= 2048).all()


@pytest.mark.parametrize("text", ["Don't STOP", "áb", "x\u001cy", "<|endoftext|> z", "naïve Ünï", "½ ² ㎏", "İ ß ſ", "a b", "'s 'LL", "­soft", "Ǆ", "1234 5,6", "it. and, !!. $, x.. ß. ª,"])
def test_word_memo(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert np.frombuffer(packing.WordMemo(path).encode([text])[0], "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_decontaminate_matches_sql(spark, medium):
    got = rows(decontaminate.op6_decontaminate(spark, medium))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{medium}/{t}.parquet'")
    want = c.execute(decontaminate.OP6_SQL).df()[list(got.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontaminate_odd(spark, odd, limit, monkeypatch):
    """Short items, items of 13 words, none and null, by broadcast and by shuffle."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit - 1)
    items = spark.createDataFrame([(1, "ONE, two!"), (2, "x"), (3, None), (4, "..."), (5, " ".join(f"w{i}" for i in range(100, 113))), (5, " ".join(f"w{i}" for i in range(100, 113))), (6, " ".join(f"w{i}" for i in range(105, 119)))], "item_id long, text string")
    got = rows(decontaminate.report(odd, items))
    by = {r.doc_id: r for r in got.itertuples()}
    assert (by[5].n_hit, by[5].n_words, by[5].n_items) == (2, 2, 1) and by[5].contaminated
    assert by[6].n_hit == 1 and by[4].n_hit == 19 and by[4].n_items == 2 and not by[4].contaminated
    assert len(got) == odd.count() and sum(got.doc_id == 5) == 2
    assert by[4].full and not by[6].full
    assert by[1].n_words == 0 and not by[1].contaminated and by[4].items_sha256 == hashlib.sha256(b"5,6").hexdigest()
    none = rows(decontaminate.report(odd, items.limit(0)))
    assert len(none) == len(got) and (none.n_hit == 0).all()


def test_decontaminate_repeated_words(spark):
    """Texts of a few words over and over, where neighbouring grams have equal hashes, against brute force."""
    r = random.Random(6)
    say = lambda n: " ".join(r.choice(["a", "a", "a", "b"]) for _ in range(n))
    texts, items = [say(r.randrange(5, 90)) for _ in range(60)] + ["a " * 200, "a b " * 40], [say(r.randrange(3, 30)) for _ in range(12)] + ["a " * 20, "b a " * 8]
    got = {x.doc_id: (x.n_hit, x.n_items) for x in decontaminate.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w, hit, met = t.split(), set(), set()
        for k, it in enumerate(items):
            x = it.split()
            n = min(13, len(x))
            wins = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit.update(range(j, j + n))
                    met.add(k)
        assert got[i] == (len(hit), len(met))


def brute_chunks(text):
    lines = text.split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    r = []
    for a, b in zip(h, h[1:], strict=False):
        # the hash of two numbers is that of the second, seeded with that of the first
        r.append(sign(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))))
    cuts = [i + 1 for i in range(len(r)) if (i == 0 or r[i] < r[i - 1]) and (i == len(r) - 1 or r[i] < r[i + 1])]
    return [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)]


@pytest.mark.parametrize("which", ["table", "odd", "collisions", "line collisions"])
def test_line_dedup(spark, medium, odd, which, monkeypatch):
    if which == "collisions":
        monkeypatch.setattr(linededup, "HASH", "cast(length(c.t) % 7 as bigint)")
    if which == "line collisions":
        monkeypatch.setattr(linededup, "HASH", "cast(length(c.t) % 7 as bigint)")
        monkeypatch.setattr(linededup, "LINE_HASH", "1L")
    docs = spark.read.parquet(f"{medium}/documents.parquet") if which != "odd" else odd
    src = rows(docs.select("doc_id", "text"))
    made = [None if t is None else brute_chunks(t) for t in src.text]
    ok = lambda c: sum(bool(x.strip(" ")) for x in c) >= 2
    first = {}
    for d, cs in zip(src.doc_id, made, strict=True):
        for c in cs or ():
            if ok(c):
                first["\n".join(c)] = min(first.get("\n".join(c), d), d)
    want = []
    for d, cs in zip(src.doc_id, made, strict=True):
        seen, kept, gone = set(), [], 0
        for c in cs or ():
            t = "\n".join(c)
            if ok(c) and (first[t] != d or t in seen):
                gone += len(c)
            else:
                kept.append(t)
            seen.add(t)
        want.append((d, None if cs is None else "\n".join(kept), sum(map(len, cs or ())), gone))
    got = rows(linededup.line_dedup(docs).select("doc_id", "text", "n_lines", "n_removed"))
    assert sorted(got.itertuples(index=False, name=None), key=str) == sorted(want, key=str)
    out = linededup.line_dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns


def test_toxicity(spark, odd):
    """Held-out labels in all languages: a third of the labels is not learned from."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    chain = toxicity.fit(docs, train)
    assert len(chain.languages) == toxicity.LINKS and [len(w) for w in chain.weights] == [len(chain.marks) + 1 + i for i in range(toxicity.LINKS + 1)]
    got = rows(toxicity.score(docs.join(test, "doc_id"), chain))
    hit, bad = got.p_toxic >= chain.threshold, got.toxic == 1
    assert (hit & bad).sum() >= 0.9 * bad.sum() and (hit & ~bad).sum() <= 0.005 * len(got)
    for i, lang in enumerate(chain.languages):  # a language's link knows its own toxic rows from the others'
        own = bad & (got.lang == lang)
        assert got[f"p_language_{i + 1}"][own].mean() > 0.6 and got[f"p_language_{i + 1}"][bad & ~own].mean() < 0.1
        assert (hit & own).sum() >= 0.85 * own.sum()
    assert toxicity.score(odd, chain).count() == odd.count() and toxicity.keep_clean(odd, labels).columns == odd.columns


def test_toxicity_folds_do_not_see_their_rows(spark):
    """A word that marks the toxic rows of one fold alone is unknown to the model that scores this fold."""
    r = random.Random(7)
    ids = list(range(3000))
    fold = {x.doc_id: x.f for x in spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("f", toxicity.fold_of(toxicity.F.col("doc_id"))).collect()}
    text = {i: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(20)) + (f" zzqqx{'klm'[fold[i]]}vv" if i % 5 == 0 else "") for i in ids}
    docs = spark.createDataFrame([(i, text[i]) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in ids], "doc_id long, toxic int")
    seen = []
    real = toxicity.fit_chain
    toxicity.fit_chain = lambda x, y, f, c: seen.append((x, y, f, c, real(x, y, f, c))) or seen[-1][-1]
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.fit_chain = real
    x, y, f, columns, (_, oof) = seen[0]
    for k in range(toxicity.FOLDS):
        own = {int(c) for c in np.flatnonzero((x[f == k] > 0).any(axis=0) & ~(x[f != k] > 0).any(axis=0))}
        assert own and not own & set(columns[k].tolist()) and own & set(columns[-1].tolist())


def test_toxicity_odd_labels(spark, odd):
    labels = spark.createDataFrame([(5, 0, 1), (5, 0, 0), (8, 1, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(odd, labels).count() == odd.count()  # too few rows to choose marks
    assert toxicity.keep_clean(odd, labels.limit(0)).count() == odd.count() and toxicity.keep_clean(odd, labels.where("toxic = 1")).count() == odd.count()
    assert toxicity.keep_clean(odd.limit(0), labels).count() == 0
    clash = odd.withColumn("p_toxic", toxicity.F.lit("mine")).withColumn("_p", toxicity.F.lit(1))
    assert toxicity.keep_clean(clash, labels).columns == clash.columns
    many = odd.crossJoin(spark.range(300).select()).select("doc_id", "text")
    got = toxicity.sample(many, labels, "toxic", 10).collect()
    assert sorted((x.doc_id, x.toxic) for x in got) == [(5, 1), (8, 0)]


def test_quality(spark, medium, odd):
    got = rows(quality.op5_quality(spark, medium)).merge(pd.read_parquet(f"{medium}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert all(got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id])
    assert (held.predicted == held.quality).mean() > 0.9 and ((got.score >= 0) & (got.score <= 1)).all()
    assert quality.score(odd.limit(0), quality.fit(odd.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).count() == 0
    some = rows(quality.score(odd.withColumn("score", quality.F.lit("x")), quality.fit(odd, spark.createDataFrame([(4, 1), (5, 0), (5, 1), (6, 0), (6, 0), (9, None)], "doc_id long, quality int"))))
    assert len(some) == odd.count() and some.score.between(0, 1).all() and some.score[some.doc_id.isin([4, 9])].nunique() == 1
    r = quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert (rows(quality.score(odd, r)).score.round(9) == 0.7).all()


@pytest.mark.parametrize("which", ["table", "odd", "copies", "same"])
def test_sharding(spark, medium, odd, which):
    docs = spark.read.parquet(f"{medium}/documents.parquet") if which == "table" else odd
    if which == "copies":  # one text has a third of the rows, fifty have a hundred each
        made = lambda i: "same text " * 20 if i % 3 == 0 else f"often {i % 50} " * 20 if i % 3 == 1 else f"text {i} " * 20
        docs = spark.createDataFrame([(i, made(i)) for i in range(15_000)], "doc_id long, text string")
    elif which == "same":  # rows that are equal in doc_id too
        docs = spark.range(4000).selectExpr("5L as doc_id", "'equal rows' as text")
    src, got = rows(docs.select("doc_id", "text")), rows(sharding.shard(docs))
    want = sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in src.itertuples(index=False))
    assert sorted(got[["doc_id", "size", "crc"]].itertuples(index=False, name=None)) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for (_, size), g in got.groupby(["crc", "size"]):
        if len(g) <= len(got) / 40 and len(g) * size <= got["size"].sum() / 40:
            assert g.shard.nunique() == 1
    if which != "odd":
        size, n = got.groupby("shard")["size"].sum(), got.groupby("shard").size()
        assert len(size) == 40 and size.max() <= size.mean() * 1.02 + (which == "table") * got["size"].max() / 4
        assert which == "table" or n.max() <= 1.05 * n.mean()


def test_sharding_small_groups(spark):
    """Groups too small to be packed one by one are balanced as well, by bytes, tokens and rows."""
    docs = spark.range(60_000).selectExpr("id as doc_id", "repeat(concat('w', id % 40000, if(id % 7 < 3, ' ', '')), cast(1 + pow(id % 40000 % 97, 1.3) as int)) as text")
    got = rows(sharding.shard(docs))
    assert all(got.groupby(["crc", "size"]).shard.nunique() == 1)
    for c in ("size", "tokens"):
        s = got.groupby("shard")[c].sum()
        assert len(s) == 40 and s.max() <= 1.02 * s.mean() and s.min() >= 0.98 * s.mean()
    n = got.groupby("shard").size()
    assert n.max() <= 1.02 * n.mean()


def test_html(spark, medium):
    pages = spark.read.parquet(f"{medium}/pages.parquet")
    model = htmltext.fit(pages)
    got = {r.page_id: r.text for r in htmltext.extract(pages, model).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", htmltext.html.unescape(re.sub("<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)
    extra = [
        ('<html><body><header><h1>Site name</h1></header><nav class="menu"><a href="/">Home</a></nav><div class="cookie-notice">We use cookies.</div><main><article><h1>Title &amp; more</h1><p>First  paragraph\n of the text.<p>Second <i>one</i>.<ul><li>item a<li>item b</ul></article><section class="comments"><h2>Comments</h2><p>Nice article!</p></section></main><aside class="sidebar"><p>Related things to read.</p></aside><form>Name <input> <button>Send</button></form><footer>Copyright</footer></body></html>', "Title & more\nFirst paragraph of the text.\nSecond one.\nitem a\nitem b"),
        (None, ""), ("", ""), ("<script>var a = '<p>x</p>'</script>", ""),
    ]
    df = spark.createDataFrame([(i, "u", h, 1) for i, (h, _) in enumerate(extra)], "page_id long, url string, html string, text int")
    assert [r.text for r in htmltext.extract(df, model).orderBy("page_id").collect()] == [t for _, t in extra]


@pytest.mark.parametrize("nameless", [False, True])
def test_html_made_up_pages(nameless):
    """Held-out made-up pages, of which it is known what is main text; nameless ones have no telling class, id or element."""
    model = htmltext.BiLstm().train(htmltext.training_pages(random.Random(99), 800))
    r, right = random.Random(7), Counter()
    made = [htmltext.known(htmltext.made_up_page(r, nameless)) for _ in range(200)]
    for (_, y), z in zip(made, model.label([f for f, _ in made]), strict=True):
        right.update((z == (y > 0)).tolist())
    assert right[True] > 0.97 * right.total()


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '", "<div>x", "<p>x", "<b><div></div>x", "<!-- ", "<script>", "<", "<i>x</i><u>", "</div></i>", "&amp;", "<p class='a b c d'>x", "<!x"])
def test_html_hostile_pages(part):
    """Four times the page takes about four times the steps, not sixteen."""
    steps = []
    for n in (4000, 16_000):
        page, seen = "<i><div>" + part * n + "</i>" * n, 0

        def count(frame, event, arg):
            nonlocal seen
            seen += 1
            return count

        sys.settrace(count)
        try:
            found = htmltext.blocks(page)
        finally:
            sys.settrace(None)
        steps.append(seen)
    assert steps[1] < 5 * steps[0] + 1000
    assert max((len(p.names) for p, *_ in found), default=0) <= 5 * htmltext.DEPTH


def test_html_vectors():
    """Vectors are those of word after word, but a word known already takes no step; what is known of words is bounded, and a page leaves nothing to the garbage collector."""
    say = lambda n: " ".join(f"wört{i * i % 97}." if i % 5 else "to" for i in range(n))
    page = lambda n: f"<html><body><nav><ul><li><a href=x class='menu b'>Home</a></ul></nav><p>{say(n)}<p>{say(2 * n)} <a>x</a></html>"
    found, steps = htmltext.blocks(page(60)), []
    want = np.zeros((len(found), htmltext.INPUT), np.float32)
    for i, (path, t, linked, chars) in enumerate(found):
        w, c = t.split(), htmltext.PATH + htmltext.WORDS
        for width, first, hashed in ((htmltext.PATH, 0, [a + x for x in path.names for a in "ab"]), (htmltext.WORDS, htmltext.PATH, w)):
            for h in (zlib.crc32(x.encode()) for x in hashed):
                want[i, first + h % width] += 1 if h >> 16 & 1 else -1
        want[i, htmltext.PATH : c] /= np.float32(4 * len(w) ** 0.5)
        want[i, c:] = np.log1p(len(w)) / 5, linked / chars, len(t) / len(w) / 20, t.count(".") / len(w), i / len(found)
    assert len(found) == 3 and (htmltext.vectors(found) == want).all() and (htmltext.vectors(found, 1, 2) == want[1:2]).all()
    for some in (htmltext.blocks(page(200)), htmltext.blocks(page(2000))):
        seen = 0

        def count(frame, event, arg):
            nonlocal seen
            seen += 1
            return count

        htmltext.vectors(some)
        sys.settrace(count)
        try:
            htmltext.vectors(some)
        finally:
            sys.settrace(None)
        steps.append(seen)
    assert steps[1] <= steps[0] + 10
    slots = htmltext._SLOTS
    known, slots.KNOWN = slots.KNOWN, 10
    try:
        slots.clear()
        assert (htmltext.vectors(found) == want).all() and len(slots) <= 10
    finally:
        slots.KNOWN = known
    del some, path, found
    gc.collect()
    gc.disable()
    try:
        htmltext.blocks(page(5))
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_html_long_page(spark):
    """A page is labelled in parts as it is in one; repeated page_ids are extracted each."""
    model = htmltext.BiLstm().train(htmltext.training_pages(random.Random(3), 60))
    body = "".join(f"<p>{i} some words and more of them in a paragraph.</p>" if i % 7 else f"<div class=nav><a href=x>{i}</a></div>" for i in range(300))
    page = f"<html><body><nav><a href=x>Home</a></nav><article>{body}</article></body></html>"
    found = htmltext.blocks(page)
    whole = model.label([found])[0]
    monkey, htmltext.LONG = htmltext.LONG, 37
    try:
        assert (model.label([found])[0] == whole).all() and 0 < whole.sum() < len(found)
    finally:
        htmltext.LONG = monkey
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "y"), (1, "v", "<p>x", "z")], "page_id long, url string, html string, text string")
    got = htmltext.extract(df, model).collect()
    assert len(got) == 3 and len({x.text for x in got if x.url == "u"}) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        simhash.near_duplicates(docs), substrings.substring_dedup(docs), quality.score(docs, quality.fit(docs, labels)), decontaminate.report(docs, items), packing.pack(docs),
        linededup.line_dedup(docs), toxicity.keep_clean(docs, labels), sharding.shard(docs), htmltext.extract(pages, htmltext.fit(pages)),
    ):
        assert out.count() == 0


def brute_runs(lines):
    """Every run of whole lines of over 50 words, by its first line."""
    return [("\n".join(lines[a:b]), a, b) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if sum(len(words(x)) for x in lines[a:b]) > 50]


def test_line_dedup_passages(spark, small):
    """Planted passages of 1 to 6 lines, and every repeated run of over 50 words on the small table."""
    r = random.Random(8)
    made = lambda n: " ".join(f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(n))
    texts = []
    for k in range(1, 7):
        shared = [made(60 // k + 1) for _ in range(k)]
        texts += ["\n".join([*(made(9) for _ in range(i % 3)), *shared, *(made(9) for _ in range(i % 2))]) for i in range(6)]
    planted = len(texts)
    texts += ["a b\n\nc d", "a b\n\nc d", made(60) + "\n" + made(3)]
    texts.append(texts[-1].split("\n")[0] + "\n" + made(4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [x.text for x in linededup.line_dedup(docs, passages=True).orderBy("doc_id").collect()]
    for i, (t, g) in enumerate(zip(texts[:planted], got, strict=False)):
        lines, k, n = t.split("\n"), i // 6 + 1, i % 6
        assert g == (t if n == 0 else "\n".join(lines[: n % 3] + lines[n % 3 + k :])), (k, n)
    assert got[planted:] == ["a b\n\nc d", "", texts[-2], texts[-1].split("\n")[1]]

    src = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").toPandas()
    out = {x.doc_id: x for x in linededup.op8_line_dedup(spark, small).collect()}
    seen, every = set(), set()
    for d, t in src.itertuples(index=False):
        lines, gone = t.split("\n"), set()
        for run, a, b in brute_runs(lines[:60]):
            if run in seen:
                gone.update(range(a, b))
            seen.add(run)
        assert out[d].n_removed >= len(gone) and out[d].n_lines == len(lines)
        if len(lines) <= 60:
            assert not Counter(lines[i] for i in gone) - (Counter(lines) - Counter(out[d].text.split("\n")))
        every.update(out[d].text.split("\n"))
    assert {x for t in src.text for x in t.split("\n") if words(x)} <= every
