"""What is shuffled follows the input and not the pairs or n-grams made of it, and the same rows come out."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import classify, grams, postings, retrieve, templates


def _shuffled(spark, run):
    """Rows written to shuffles while ``run`` runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def _letters(spark, folder, times=1):
    """The documents of a folder, each ``times`` times under other ids."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").crossJoin(spark.range(times)).coalesce(2)
    return docs.select((F.col("doc_id") + 1_000_000 * F.col("id")).alias("doc"), "text", F.col("lang").alias("label"))


@pytest.mark.parametrize("buffer, held", [(1 << 21, 1 << 20), (50, 40)])
def test_gram_totals(spark, monkeypatch, buffer, held):
    """As counted one by one, also where a task passes on what it holds early."""
    monkeypatch.setattr(grams, "BUFFER", buffer)
    monkeypatch.setattr(grams, "HELD", held)
    rows = [(1, "aaaa b"), (1, "अआa\0"), (2, ""), (2, "a"), (2, "𝒳aaa"), (None, "aa")]
    counts = Counter((g, s[i : i + n]) for g, s in rows for n in (2, 3, 4) for i in range(len(s) - n + 1))
    df = Counter((g, x) for g, s in rows for x in {s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1)})
    kept = grams.Counts(2, 4)
    got_c, got_df = Counter(), Counter()
    for g, s in rows:
        for group, names, c, d in [*kept.add((g,), s)]:
            got_c.update({(group[0], x): int(k) for x, k in zip(names, c, strict=True)})
            got_df.update({(group[0], x): int(k) for x, k in zip(names, d, strict=True)})
    for group, names, c, d in kept.flush():
        got_c.update({(group[0], x): int(k) for x, k in zip(names, c, strict=True)})
        got_df.update({(group[0], x): int(k) for x, k in zip(names, d, strict=True)})
    assert got_c == counts and got_df == df
    found = grams.totals(spark.createDataFrame(rows, "g int, t string"), ["g"], 2, 4).collect()
    assert {(r.g, r.gram): r.c for r in found} == counts and {(r.g, r.gram): r.df for r in found} == df


def test_more_characters_than_numbers(spark):
    """Characters beyond what a key can number: all is passed on and numbering begins anew."""
    counts, got = grams.Counts(2, 4), Counter()
    texts = ["".join(map(chr, range(0x4E00 + 9_000 * i, 0x4E00 + 9_000 * i + 9_000))) for i in range(2)] + ["".join(map(chr, range(0x20000, 0x20000 + 20_000)))]
    for t in [*texts, texts[0]]:
        for _, names, c, _ in counts.add((), t):
            got.update(dict(zip(names, c.tolist(), strict=True)))
    for _, names, c, _ in counts.flush():
        got.update(dict(zip(names, c.tolist(), strict=True)))
    assert got == Counter(t[i : i + n] for t in [*texts, texts[0]] for n in (2, 3, 4) for i in range(len(t) - n + 1))


def test_classifier_shuffles_no_grams_of_letters(spark, small):
    """Four times the letters: the classifier's shuffles stay far below four times the rows."""

    def run(times):
        docs = _letters(spark, small, times)
        folded = classify.folds(docs)
        classify.report(classify.cross_validate(folded.drop("text"), classify.nb_counts(docs))).collect()

    one, four = (_shuffled(spark, lambda t=t: run(t)) for t in (1, 4))
    assert four < 2 * one


def test_model_in_blocks(spark, small, monkeypatch):
    """A model that meets the letters in blocks gives what it gives at once."""
    docs = _letters(spark, small)
    counts = classify.nb_counts(docs)
    model, classes = classify.nb_fit(docs, counts)
    once = sorted((r.doc, r.label, round(r.score, 6)) for r in classify.nb_predict(counts, model, classes).collect())
    monkeypatch.setattr(grams, "BLOCK", 40_000)
    monkeypatch.setattr(grams, "AT_ONCE", 3_000)
    assert sorted((r.doc, r.label, round(r.score, 6)) for r in classify.nb_predict(counts, model, classes).collect()) == once


def test_predictions_shuffle_no_grams_of_letters(spark, small):
    def run(times):
        docs = _letters(spark, small, times)
        counts = classify.nb_counts(docs)
        classify.nb_predict(counts, *classify.nb_fit(docs, counts)).collect()

    one, four = (_shuffled(spark, lambda t=t: run(t)) for t in (1, 4))
    assert four < 2 * one


def test_likelihoods_shuffle_no_grams_of_letters(spark, small):
    def run(times):
        docs = _letters(spark, small, times)
        classify.nb_fit(docs, classify.nb_counts(docs))[0].collect()

    one, four = (_shuffled(spark, lambda t=t: run(t)) for t in (1, 4))
    assert four < 2 * one


def _queries(docs, times):
    return docs.where(f"doc % {times} = 0").select(F.col("doc").alias("query"), F.substring_index("text", "\n", 1).alias("text"))


def test_bm25_shuffles_no_pairs(spark, small):
    """Four times the letters and the queries, which is 16 times the pairs: rows in shuffles follow the queries."""

    def run(times):
        docs = _letters(spark, small, times)
        retrieve.top(retrieve.bm25(docs, _queries(docs, 2), k=5), 5).collect()

    one, four = (_shuffled(spark, lambda t=t: run(t)) for t in (1, 4))
    assert four < 8 * one and one < 200 * 5 * 4


@pytest.mark.parametrize("own", [True, False])
def test_bm25_best(spark, small, monkeypatch, own):
    """With k the best of each query as all scores have them, also in blocks of queries and of postings; copies tie."""
    docs = _letters(spark, small, 2).repartition(3, "doc")
    q = _queries(docs, 7)
    found = retrieve.bm25(docs, q)
    want = sorted(map(tuple, retrieve.top(found if own else found.where("query <> doc"), 4).collect()))
    monkeypatch.setattr(retrieve, "ASKED", 20)
    monkeypatch.setattr(retrieve, "HELD", 300)
    post = postings.postings(docs)
    got = retrieve.bm25_scores(post, postings.lengths(docs), q, k=4, own=own)
    assert got.count() > len(want)
    assert sorted(map(tuple, retrieve.top(got, 4).collect())) == want


def test_bm25_by_brute_force(spark):
    docs = [(1, "the cat the end"), (2, "the dog"), (3, ""), (4, None), (5, "a dog and a Cat")]
    asked = [(1, "the cat, cat"), (2, "bird of"), (3, ""), (4, None), (5, "DOG")]
    d, q = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(asked, "query int, text string")
    words = {i: t.lower().split() for i, t in docs if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for query, t in asked:
        for w in (t or "").lower().replace(",", "").split():
            df = sum(w in x for x in words.values())
            for doc, x in words.items():
                if w in x and len(w) > 1:
                    tf = x.count(w)
                    want[query, doc] = want.get((query, doc), 0) + max(1e-6, math.log((len(docs) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    got = {(r.query, r.doc): r.score for r in retrieve.bm25(d, q).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_lines_shuffle_as_hashes(spark):
    """Mining shuffles no lines: what it writes is far less than the texts, and repeats in a letter count once."""
    rows = [(i, "x", "y", "\n".join([f"Shared heading {i}", *(f"own {chr(97 + i % 20)}{chr(97 + j)} " + " ".join(chr(97 + (i * 7 + j * 5 + k * k) % 26) * 8 for k in range(40)) for j in range(10)), *["twice"] * (i == 3) * 30])) for i in range(60)]
    letters = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(2).persist()
    cell, kept = ["lang", "source"], []

    def run():
        near = templates.shared(templates.lines(letters, cell), templates.cells(letters, cell), cell)
        kept.extend(templates.boilerplate(near, templates.cells(letters, cell), cell).collect())

    letters.count()
    store = spark.sparkContext._jsc.sc().statusStore()
    array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def size():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, array, None)
        return {s.stageId(): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = size()
    run()
    assert [(r.canon, r.letters, r.n) for r in kept] == [("Sharedheading#", 60, 60)]
    assert sum(n for k, n in size().items() if k not in before) < 0.25 * sum(len(r[3]) for r in rows)


def test_hit_rates_shuffle_no_words_of_letters(spark, small, monkeypatch):
    """As counted one by one, also with the vocabulary in blocks, and a row for each letter besides the words' counts."""
    docs = _letters(spark, small, 2)
    words = {r.doc: r.t for r in docs.select("doc", T.tokens("text").alias("t")).collect()}
    df = Counter(w for t in words.values() for w in set(t))
    want = {d: pytest.approx(sum(df[w] >= 3 for w in t) / len(t)) for d, t in words.items() if t}
    monkeypatch.setattr(postings, "WORDS", 700)
    got = {}
    n = _shuffled(spark, lambda: got.update({r.doc: r.hit_rate for r in postings.hit_rates(postings.postings(docs), 3).collect()}))
    assert got == want and n < 0.5 * sum(len(set(t)) for t in words.values())
