"""The pipeline against the stages' own brute-force meaning, on the small table."""

import random

import pytest

import corpus_pipeline
from quillspark.llm import decontaminate, nearcopies, simhash


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {d.doc_id for d in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), before.schema)
        assert docs.columns == before.columns, name
        ids = [r.doc_id for r in docs.collect()]
        assert set(ids) <= seen and len(ids) > 0.5 * len(seen), name
        seen = set(ids)
        if name == "near_duplicates":
            prints = [simhash.fingerprint(r.text) for r in docs.where("trim(text) <> ''").collect()]
            assert all(bin(a ^ b).count("1") > 2 for i, a in enumerate(prints) for b in prints[:i])
    assert not decontaminate.report(docs, spark.read.parquet(f"{small}/benchmark.parquet")).where("contaminated").count()
    got = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in got} == seen
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in got)


def table_of(spark, texts):
    return spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies(spark, small):
    """Of words that differ in one place in 100 one copy stays, in pairs and in a large group; at a similarity below 0.8 both stay."""
    r = random.Random(4)
    made = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    texts, want = [], set()
    for _ in range(20):
        a = made(100)
        b, c = [*a], [*a]
        b[50] = "changed"
        for i in range(10, 100, 20):
            c[i] = "other"
        want |= {len(texts), len(texts) + 2}
        texts += [a, b, c]
    base, first = made(200), len(texts)
    for i in range(60):
        texts.append([*base])
        texts[-1][r.randrange(200)] = f"v{i}"
    want.add(first)
    docs = table_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, small).collect()} == want


def test_equal_texts(spark, small):
    """Of equal texts one document stays, and of those that line dedup empties one."""
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(5))
    docs = table_of(spark, [*((i, long) for i in range(5)), (5, "short one"), (6, "short one"), (7, ""), (8, " \n"), (9, "a b\nc d\ne f"), (10, "a b\nc d\ne f")])
    out = corpus_pipeline.drop_repeated_lines(spark, docs, small)
    assert {x.doc_id for x in out.where("text = ''").collect()} == {1, 2, 3, 4, 7, 10}
    assert {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, out, small).collect()} == {0, 1, 5, 9}


def test_near_copies_repeated_ids(spark, small):
    """A doc_id with two texts loses only the one that is a copy; a row repeated whole stays once."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    docs = table_of(spark, [(1, a), (1, a), (2, a), (2, b), (3, c), (3, c)])
    assert sorted((x.doc_id, x.text) for x in corpus_pipeline.drop_near_copies(spark, docs, small).collect()) == [(1, a), (2, b), (3, c)]


def test_contaminated_long_text(spark, small):
    """A passage of 13 benchmark words under a twentieth of a long text drops it; 12 words do not, and clean texts stay."""
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text.split()
    r = random.Random(5)
    made = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    docs = table_of(spark, [(1, " ".join([*made(2000), *item[:13], *made(2000)])), (2, " ".join([*made(100), *item[:12], *made(10)])), (3, " ".join(made(50))), (4, "")])
    assert {x.doc_id for x in corpus_pipeline.drop_contaminated(spark, docs, small).collect()} == {2, 3, 4}


def test_odd_rows(spark, small):
    """Nulls, empty and very long texts, repeated rows, extra columns of clashing names and an empty table."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (5, "one two"), (5, "three four"), (6, "x"), (None, "a null id")]
    docs = spark.createDataFrame([(d, t, None, None, None, 1, 2) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, th long, n int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), small).count() == 0
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(x.doc_id), x.text or "") for x in docs.collect())
    assert got == sorted([("1", ""), ("4", long), ("5", "one two"), ("5", "three four"), ("6", "x"), ("None", "a null id")])
    assert corpus_pipeline.pack(spark, docs, small).count() > 5 and corpus_pipeline.pack(spark, docs.limit(0), small).count() == 0


def test_copies_of_one_text(spark, small):
    """Copies that are near their original, but mostly not near each other, leave one of each group, whatever the order."""
    r = random.Random(1)
    texts, groups = [], []
    for g, m in enumerate([2, 3, 5, 10, 40, 3, 10, 40]):
        base = [f"w{r.randrange(10**6)}" for _ in range(120)]
        copies = [[*base] for _ in range(m)]
        for c in copies:
            for _ in range(2):
                c[r.randrange(120)] = f"x{r.randrange(10**6)}"
        copies.insert(r.randrange(m + 1), base)
        texts += [" ".join(c) for c in copies]
        groups += [g] * len(copies)
    out = corpus_pipeline.drop_near_copies(spark, table_of(spark, list(enumerate(texts))), small)
    assert sorted(groups[x.doc_id] for x in out.collect()) == list(range(8))


def drifting(r, groups, each, most):
    """Texts of 100 words, of each group with 1 to most words of one original changed."""
    texts = []
    for _ in range(groups):
        base = [f"w{r.randrange(10**6)}" for _ in range(100)]
        for _ in range(each):
            texts.append([*base])
            for _ in range(r.randrange(1, most + 1)):
                texts[-1][r.randrange(100)] = f"x{r.randrange(10**6)}"
    return texts


def least_of_classes(texts):
    """The first text of each class that pairs at a similarity of 0.8, or op2's links, connect, by brute force."""
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    prints = [simhash.fingerprint(" ".join(t)) for t in texts]
    to = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if to[i] != to[j] and (10 * shared >= 8 * (len(a) + len(sets[j]) - shared) or (prints[i] ^ prints[j]).bit_count() <= 2):
                old, new = max(to[i], to[j]), min(to[i], to[j])
                to = [new if x == old else x for x in to]
    return set(to)


def test_near_copies_of_copies(spark, small):
    """Texts that are near each other, but one of them not near the text that the others were copied from, are linked."""
    texts = drifting(random.Random(11), 40, 40, 7)
    out = corpus_pipeline.drop_near_copies(spark, table_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), small)
    assert {x.doc_id for x in out.collect()} == least_of_classes(texts)


@pytest.mark.parametrize("large", [8192, 8])
def test_hot_buckets(spark, small, monkeypatch, large):
    """Buckets that are dealt in blocks give the same classes, whether few or many of their texts are left unlinked."""
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    monkeypatch.setattr(nearcopies, "LARGE", large)
    texts = drifting(random.Random(12), 4, 120, 9)
    out = corpus_pipeline.drop_near_copies(spark, table_of(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), small)
    assert {x.doc_id for x in out.collect()} == least_of_classes(texts)
