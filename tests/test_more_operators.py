"""Skeletons, the trained classifier, corrections, the audit, review sheets and stored postings."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import classify, draft, fonts, postings, retrieve, segment, skeletons, store
from quillspark.plans import fixtures as X
from quillspark.sources import archive, sinks


def test_parse_skeleton(spark):
    new = "# क / ख (9 letters)\n\n## Before the subject\n12x " + X.HEAD + "\n\n# a note\n" + X.LETTER_1[1] + "\n## Salutation\nमहाशय,\n\n## After the body\nविश्वासभाजन\n## Slots\nनाम\n## Body: about 450 characters\n## dropped\nnever\n"
    old = "# क / ख\n## fixed lines\n" + "\n".join([X.HEAD, "महाशय,", "विश्वासभाजन", "जिला पदाधिकारी"])
    got = [r.s for r in spark.createDataFrame([(0, new), (1, old), (2, "nothing")], "id int, t string").orderBy("id").select(skeletons.parse(F.col("t")).alias("s")).collect()]
    assert (got[0].before, got[0].salutation, got[0].after, got[0].blanks, got[0].median_body_chars) == ([X.HEAD, X.LETTER_1[1]], ["महाशय,"], ["विश्वासभाजन"], ["नाम"], 450)
    assert (got[1].before, got[1].salutation, got[1].after, got[1].median_body_chars) == ([X.HEAD], ["महाशय,"], ["विश्वासभाजन", "जिला पदाधिकारी"], 600)
    assert (got[2].before, got[2].after) == ([], [])


def test_load_skeletons(spark, tmp_path):
    letters = spark.createDataFrame([(i, "\n".join(X.LETTER_1), "क" if i % 2 else "राजस्व", "ख") for i in range(20)] + [(20, "x", None, "ख")], "doc_id long, text string, department string, letter_type string")
    mined = {(r.department, r.letter_type): r for r in skeletons.load(letters).collect()}
    assert set(mined) == {("क", "ख"), ("राजस्व", "ख"), ("", "")} and X.HEAD in mined["", ""].before and "महाशय," in mined["क", "ख"].salutation
    with pytest.warns(UserWarning, match="holds no skeletons"):
        assert skeletons.load(letters, str(tmp_path)).count() == 3
    (tmp_path / "a.md").write_text("no heading")
    with pytest.raises(ValueError, match="none of the skeletons"):
        skeletons.load(letters, str(tmp_path))
    (tmp_path / "b.md").write_text("# क / ख\n## Before the subject\nअपना\n## After the body\nभवदीय\n")
    got = {(r.department, r.letter_type): r for r in skeletons.load(letters, str(tmp_path)).collect()}
    assert got["क", "ख"].before == ["अपना"] and got["राजस्व", "ख"].before == mined["राजस्व", "ख"].before


def test_trained_classifier(spark):
    words = {"a": "alpha beta gamma delta", "b": "omega sigma theta kappa"}
    rows = [(i, f"{words['ab'[i % 2]]} {i}", "ab"[i % 2], "only" if i < 12 else None) for i in range(30)] + [(99, "rare one", "c", None)]
    letters = spark.createDataFrame(rows, "doc long, text string, department string, letter_type string")
    model = classify.TrainedClassifier.fit(letters)
    assert set(model.models) == {"department"} and model.letter_type_confident is False
    asked = spark.createDataFrame([(1, "beta gamma"), (2, "kappa theta sigma"), (3, "\n".join(X.LETTER_2))], "doc long, text string")
    got = {r.doc: r for r in model.predict(asked).collect()}
    assert (got[1].department, got[2].department) == ("a", "b") and got[1].department_confidence > 0.5 and got[1].letter_type is None and got[1].letter_type_confidence == 0
    strict = classify.TrainedClassifier(model.models, {"department": 1.01}).predict(asked).collect()
    assert all(r.department is None and r.department_confidence > 0 for r in strict)
    said = {r.doc: r for r in draft.classify_requests(asked, model).collect()}
    assert said[1].department == "a" and said[1].department_source.startswith("model (0.") and (said[3].department, said[3].department_source) == ("स्थापना", "branch")
    alone = {r.doc: r for r in draft.classify_requests(asked).collect()}
    assert (alone[1].department, alone[1].department_source) == (None, "none")


def test_correct_and_score(spark):
    good, bad = "\n".join(X.LETTER_2), "काी काी"
    letters = store.with_hash(spark.createDataFrame([(1, bad, "docx"), (2, bad, "docx"), (3, good, "pdf")], "doc_id long, text string, source_tier string"))
    got = {r.doc_id: r for r in store.correct_and_score(letters, spark.createDataFrame([(1, f" {good}\n"), (2, " \n"), (9, good)], "doc_id long, text string")).collect()}
    assert set(got) == {1, 2, 3} and got[2].text == bad and got[2].trust is None
    one = got[1]
    want = spark.createDataFrame([(good,)], "text string").select(T.quality("text").alias("q"), F.sha2(F.col("text").cast("binary"), 256).alias("h")).first()
    assert (one.text, one.text_hash, one.conversion_confidence, one.form, one.subject) == (good, want.h, want.q, "letter", "वेतन भुगतान के संबंध में")
    assert one.trust == pytest.approx(0.45 * one.conversion_confidence + 0.35 * one.completeness + 0.2 * 0.85, abs=1e-4) and one.verdict == "index" and one.violations == {}


def test_drafts_and_views(spark, tmp_path):
    d = spark.createDataFrame([("r", "t"), ("r2", None)], "request string, draft_text string")
    ids = {r.id for r in store.record_drafts(d, str(tmp_path / "d")).collect()}
    store.record_drafts(d.limit(0), str(tmp_path / "d"))
    assert len(ids) == 2 and {r.id for r in spark.read.parquet(str(tmp_path / "d")).collect()} == ids
    letters = spark.createDataFrame([(1, 0.9, "index", "letter"), (2, 0.5, "review", None), (3, 0.7, "review", "order")], "doc_id long, trust double, verdict string, form string")
    assert [r.doc_id for r in store.browse(letters, "review").collect()] == [2, 3] and [r.doc_id for r in store.browse(letters, form="letter").collect()] == [1]
    assert (store.count(letters).first().n, store.count(letters, "review").first().n) == (3, 2)


def test_repair_and_usage(spark):
    got = spark.createDataFrame([(1, "नामः राम ,और"), (2, "साफ")], "id int, t string").orderBy("id").select(T.repair("t").alias("r")).collect()
    assert [(x.r.text, x.r.visarga_to_colon, x.r.punctuation_tidied) for x in got] == [("नाम: राम, और", 1, 1), ("साफ", 0, 0)]
    docs = spark.createDataFrame([([[("dk CWJC-12 ", "Kruti Dev 010"), ("plain", "Arial")]],)], "blocks array<array<struct<text:string,font:string>>>")
    assert {r.table: r.chars for r in fonts.table_usage(docs).collect()} == {"krutidev010": 4, "(rescued-latin)": 7, "(passthrough)": 5}
    assert {r.table: r.chars for r in fonts.table_usage(docs, force="devlys010", rescue=False).collect()} == {"devlys010": 16}


def test_audit(spark):
    seg = segment.segment(spark.createDataFrame(X.DOCUMENTS, "doc_id int, text string"))
    counts = {r.anchor: (r.lines, r.letters) for r in segment.anchor_counts(seg).collect()}
    assert counts["letter_number"] == (9, 7) and counts["distribution"] == (1, 1)
    made = spark.createDataFrame([(i, 0, "x" * 100, {"closing": 1}) for i in range(40)] + [(50, 0, "x" * 900, {"closing": 2}), (51, 0, "x" * 800, {"subject": 1})], "doc_id long, seq int, text string, anchors map<string,int>")
    assert sorted((r.doc_id, r.p95, r.merged) for r in segment.outliers(made, times=5).collect()) == [(50, 100, True), (51, 100, False)]
    assert {r.opened_by: r.share for r in segment.shares(seg, "opened_by").collect()}["file-start"] == 0.75


def test_review_and_gold_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "dk", "का", False, "f"), (2, "d", "क", True, "f")], "id int, legacy string, suggested string, blind boolean, font string")
    got = sinks.review_rows(rows).orderBy("id").collect()
    assert [(r.suggested, r.blind, r.font, r.table) for r in got] == [("का", "", "f", ""), ("", "yes", "f", "")]
    sinks.gold_lines(spark.createDataFrame([("dk", "का")], "legacy string, expected string"), "own", "seen").coalesce(1).write.text(str(tmp_path / "gold"))
    back = archive.gold_pairs(spark, str(tmp_path / "gold")).collect()
    assert [(r.legacy, r.expected, r.table, r.note) for r in back] == [("dk", "का", "own", "seen")]
    for n in ("2024-01", "2024-02", "2024-03"):
        sinks.snapshot(rows, str(tmp_path / "s" / n))
    assert sinks.prune(spark, str(tmp_path / "s"), 2) == ["2024-01"] and sorted(x.name for x in (tmp_path / "s").iterdir()) == ["2024-02", "2024-03"]
    for n in ("b.tsv", "a.tsv", "c.txt"):
        (tmp_path / n).write_text("k\tा\n")
    assert [r.name for r in fonts.list_tables(spark, str(tmp_path)).collect()] == ["a", "b"]


def test_injected_readers(spark, tmp_path):
    assert archive.from_text(spark, "एक\n\n\n\nदो").first().blocks[0][0].text == "एक"
    assert set(archive.tools(("python3", "no-such-program")).items()) >= {("no-such-program", None)} and archive.languages("List of languages (2):\nhin\neng\n") == ["eng", "hin"]
    (tmp_path / "a.png").write_bytes(b"good")
    (tmp_path / "b.png").write_bytes(b"bad")

    def reader(content):
        if content == b"bad":
            raise ValueError("noise")
        return "पाठ", 0.9

    got = {r.path[-5:]: r for r in archive.read_with(archive.walk(spark, str(tmp_path)), "image", reader).collect()}
    assert (got["a.png"].text, got["a.png"].confidence) == ("पाठ", 0.9) and "noise" in got["b.png"].error


def test_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "एक दो दो"), (2, "दो तीन"), (3, "चार")], "doc long, text string")
    q = spark.createDataFrame([(7, "दो तीन"), (8, "चार")], "query long, text string")
    postings.build(docs, str(tmp_path / "i"))
    want = sorted(retrieve.bm25(docs, q).collect())
    assert sorted(retrieve.bm25_scores(*postings.load(spark, str(tmp_path / "i")), q).collect()) == want
    changed, gone = spark.createDataFrame([(2, "चार चार"), (4, "दो")], docs.schema), docs.where("doc = 1")
    postings.refresh(spark, str(tmp_path / "i"), changed, gone, str(tmp_path / "j"))
    new = docs.where("doc = 3").unionByName(changed)
    assert sorted(retrieve.bm25_scores(*postings.load(spark, str(tmp_path / "j")), q).collect()) == sorted(retrieve.bm25(new, q).collect())


def test_configurations(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} common text {i}", "ab"[i % 2], "x") for i in range(20)], "doc long, text string, department string, letter_type string")
    q = docs.where("doc < 4").select(F.col("doc").alias("query"), "text", "department", "letter_type")
    found = retrieve.configurations(docs, q, retrieve.bm25(docs, q), retrieve.tfidf(docs, q))
    assert len(found) == 8
    out = {r.config: r for r in retrieve.sweep(found, q, docs.select("doc", F.col("department").alias("cell"))).collect()}
    assert out["tfidf+dept"].p5 == 1.0 and out["rrf"].recall5 == 1.0 and out["random"].n == 4
    a = spark.createDataFrame([(0.5, 0.02, 0.6, 0.02), (0.5, 0.02, 0.52, 0.02)], "a double, b double, c double, d double").select(retrieve.adopt(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).collect()
    assert sorted(r.x for r in a) == [False, True]
