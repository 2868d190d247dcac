"""Operators that the queries don't reach: sources, sinks, streaming, drafting, fold-in details."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions import text as T
from quillspark.operators import classify, draft, encode, fonts, gold, retrieve, segment, store, templates
from quillspark.plans import fixtures as X
from quillspark.sources import archive, sinks
from quillspark.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, body, styles=None):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        if styles is not None:
            z.writestr("word/styles.xml", styles)
    path.write_bytes(buf.getvalue())


def test_archive(spark, tmp_path):
    styles = f'<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Arial"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="K"><w:rPr><w:rFonts w:hAnsi="Kruti Dev 010"/></w:rPr></w:style></w:styles>'
    docx(tmp_path / "a.docx", '<w:p><w:pPr><w:pStyle w:val="K"/></w:pPr><w:r><w:t>dk</w:t><w:tab/></w:r><w:r><w:rPr><w:rFonts w:ascii="X"/></w:rPr><w:t>y</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>skip</w:t></w:r></w:hyperlink></w:p><w:p><w:r><w:t>z</w:t></w:r></w:p><w:p/>', styles)
    docx(tmp_path / "b.docx", "<w:p/>", "<broken")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.doc").write_bytes(bytes.fromhex("D0CF11E0A1"))
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "e.xyz").write_text("other")
    files = archive.walk(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[-1] for r in files.collect()) == ["a.docx", "b.docx", "c.docx", "d.doc"]
    assert "docx" in files.where("path like '%d.doc'").first().error
    got = {r.path[-6:]: r for r in archive.read_docx(files).collect()}
    assert [[(x.text, x.font) for x in b] for b in got["a.docx"].blocks] == [[("dk\t", "Kruti Dev 010"), ("y\n", "X")], [("z", "Arial")]]
    assert set(got["b.docx"].warnings) == {"styles can't be read", "no text"} and got["c.docx"].error
    hist = {r.font: r.chars for r in archive.font_histogram(archive.read_docx(files)).collect()}
    assert hist == {"Kruti Dev 010": 3, "X": 2, "Arial": 1}
    docs = fonts.convert_document(archive.read_docx(files).where("path like '%a.docx'"), {"krutidev010": X.TOY})
    assert docs.first().text == "का y\nz" or "का" in docs.first().text


def test_text_files(spark, tmp_path):
    for name, data in (("u8", "﻿एक\fदो\n\n\n\nतीन".encode()), ("u16", "एक".encode("utf-16")), ("cp", b"caf\xe9s")):
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    got = {r.path.rsplit("/", 1)[-1]: [b[0].text for b in r.blocks] for r in archive.read_text(files).collect()}
    assert got == {"u8": ["एक", "दो", "", "तीन"], "u16": ["एक"], "cp": ["cafés"]}


def test_tables(spark, tmp_path):
    (tmp_path / "base.tsv").write_text("# a comment\n#\tहै\nk\tा\nZ\tZ\n")
    (tmp_path / "own.tsv").write_text("#inherit base\nk\tी\tnote\n")
    (tmp_path / "ring.tsv").write_text("#inherit ring\n")
    assert fonts.read_table(spark, str(tmp_path), "own").pairs == {"#": "है", "k": "ी", "Z": rules.REPH_MARK}
    with pytest.raises(ValueError, match="circle"):
        fonts.read_table(spark, str(tmp_path), "ring")
    (tmp_path / "gold").write_text("# note\na\tb\n#\tc\tother\tn\nalone\n")
    assert [tuple(r) for r in archive.gold_pairs(spark, str(tmp_path / "gold")).collect()] == [("a", "b", "krutidev010", None), ("#", "c", "other", "n")]


def test_page_confidence(spark):
    df = spark.createDataFrame([("p", 1, 50.0), ("p", 1, 70.0), ("p", 2, 90.0)], "path string, page int, conf double")
    assert tuple(archive.page_confidence(df).first()) == ("p", 2, 75.0, 0.333333)


def test_skeleton_round_trip(spark, tmp_path):
    rows = [(i, "क", "ख", "\n".join([*X.LETTER_1[:2], *X.LETTER_1[5:7], f"यह {i}{i}x निवेदन {chr(0x905 + i)} है।", *X.LETTER_1[8:]])) for i in range(8)]
    letters = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    sk = templates.skeletons(letters, ["lang", "source"])
    r = sk.first()
    assert r.n == 8 and [x.literal for x in r.boilerplate][:2] == X.LETTER_1[:2] and r.coverage > 0.5
    md = sinks.skeleton_markdown(sk, "lang", "source").first()
    (tmp_path / "x.md").write_text(md.value)
    back = archive.skeleton_files(spark, str(tmp_path)).first()
    assert (back.department, back.letter_type, back.before[:2], back.salutation) == ("क", "ख", X.LETTER_1[:2], [X.LETTER_1[6]])


def test_stream_ingest(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    add = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    add([(1, "a"), (2, "a"), (3, "b")])
    docs = lambda: ingest.stream_documents(spark, src, "doc_id long, text string")
    ingest.ingest(docs(), out, ck).awaitTermination()
    add([(4, "b"), (5, "c")])
    ingest.ingest(docs(), out, ck).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect()) == [(1, "a"), (3, "b"), (5, "c")]
    q = ingest.running_counts(docs(), "text").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.text: r.n for r in spark.table("counts").collect()} == {"a": 2, "b": 2, "c": 1}


def test_event_windows_with_watermark(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    a, b = ingest.event_windows(events), ingest.event_windows(events, late="1 hour")
    assert a.exceptAll(b).count() == 0 and ingest.event_windows(events, "1 hour", "30 minutes").count() > a.count()


def test_assemble(spark):
    df = spark.createDataFrame([("मुख्य बात।", X.LETTER_1[:2], [X.LETTER_1[6]], [], "मापी।", "77", "01.01.2024")], "body string, before array<string>, salute array<string>, after array<string>, subject string, number string, `on` string")
    got = df.select(draft.assemble(*map(F.col, df.columns)).alias("x")).first().x.split("\n")
    assert got == [X.HEAD, "पत्रांक- 77/रा०, दिनांक 01.01.2024", "विषय:- मापी।", "महाशय,", "", "मुख्य बात।", "", "विश्वासभाजन"]


def test_exemplar_body(spark):
    df = spark.createDataFrame([("\n".join(X.LETTER_1),), ("plain\ntext",)], "t string")
    assert [r.x for r in df.select(draft.exemplar_body("t").alias("x")).collect()] == [X.LETTER_1[7], "plain\ntext"]
    assert draft.truncate("word " * 1000, 260).endswith(" …") and draft.prompt_limit(1000) == 256


def test_filters_reject_nulls(spark):
    df = spark.createDataFrame([(1, None, "a", "x"), (2, 0.5, None, "x"), (3, 0.5, "a", "x")], "id int, trust double, department string, letter_type string")
    assert [r.id for r in df.where(store.keep(0.0, "a")).collect()] == [3]
    assert [r.id for r in df.where(store.keep(0.0, exclude=(3,))).collect()] == [2]


def test_record_dispatch(spark):
    drafts = spark.createDataFrame([(1, "abcd"), (2, "x")], "id int, draft_text string")
    sent = spark.createDataFrame([(1, "abcx"), (9, "none")], "id int, text string")
    got = {r.id: (r.dispatched_text, r.effort) for r in store.record_dispatch(drafts, sent).collect()}
    assert got == {1: ("abcx", 0.25), 2: (None, None)}
    assert store.effort_summary(drafts.select(F.lit(None).cast("double").alias("effort"))).first().n == 0


def test_effort_quantiles(spark):
    got = store.effort_summary(spark.createDataFrame([(i / 100,) for i in range(1, 21)], "effort double")).first()
    assert (got.n, got.median, got.p90, got.as_drafted) == (20, pytest.approx(0.105), 0.18, 10)


def test_extra_anchors():
    assert "my label" in rules.anchor_pattern("subject", {"subject": ["my label"]})
    with pytest.raises(ValueError, match="unknown"):
        rules.anchor_pattern("subject", {"nothing": ["x"]})


def test_segment_scores(spark):
    docs = spark.createDataFrame(X.DOCUMENTS, "doc_id int, text string")
    got = segment.score(segment.segment(docs), F.lit("docx")).collect()
    assert all(0 <= r.trust <= 1 and r.verdict in ("index", "review", "quarantine") for r in got)
    assert segment.segment(docs.where("doc_id = 4")).count() == 0


def test_naive_bayes_folds_agree(spark, small):
    """One pass over all folds gives what a model for each fold gives."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("doc"), "text", F.col("lang").alias("label"))
    docs = classify.folds(docs, k=3)
    counts = classify.nb_counts(docs).persist()
    one = {r.doc: r.label for r in classify.cross_validate(docs.drop("text"), counts).collect()}
    for f in range(3):
        train = docs.where(F.col("fold") != f)
        model, classes = classify.nb_fit(train, counts.join(train.select("doc"), "doc", "left_semi"))
        test = counts.join(docs.where(F.col("fold") == f).select("doc"), "doc", "left_semi")
        for r in classify.nb_predict(test, model, classes).collect():
            assert one[r.doc] == r.label
    assert classify.summary(classify.report(classify.cross_validate(docs.drop("text"), counts))).first().accuracy > 0.9
    counts.unpersist()


def test_short_and_empty_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, "a"), (3, "ab"), (4, "abc")], "doc int, text string")
    got = {(r.doc, r.gram) for r in retrieve.gram_counts(df).collect()}
    assert got == {(4, "abc")}
    grams = {r.doc: r.g for r in df.select("doc", T.char_ngrams("text", 2, 3).alias("g")).collect()}
    assert grams == {1: [], 2: [], 3: ["ab"], 4: ["ab", "bc", "abc"]}


def test_greedy_and_blind(spark):
    items = spark.createDataFrame(X.PICKS, "legacy string, used_keys array<string>")
    assert gold.greedy_cover(items, 1) == [("bb", 3)] and gold.greedy_cover(items.where("legacy = 'f'"), 3) == []
    assert gold.mark_blind(items, 0.5).where("blind").count() == 3


def test_cards(spark):
    df = spark.createDataFrame([(True, 50, 1.0), (False, 100, 0.97)], "seed boolean, n int, char_accuracy double")
    assert not gold.conversion_card(df).first().usable and not gold.conversion_card(df.where("seed")).first().usable
    one = spark.range(1).select(gold.retrieval_card(F.lit(100), F.lit(0.5), F.lit(0.06), F.lit(0.03)).alias("r"), gold.drafting_card(F.lit(5), F.lit(0.1)).alias("d")).first()
    assert (one.r, one.d) == ("beats random", "too few dispatches")


def test_docx_writer_reads_back(spark):
    df = spark.createDataFrame([("one & <two>\n\nthree",)], "t string").select(sinks.docx_bytes("t", "Mangal").alias("b"))
    blocks, warnings = archive.docx_blocks(bytes(df.first().b))
    assert [[(r["text"], r["font"]) for r in b] for b in blocks] == [[("one & <two>", "Mangal")], [("three", "Mangal")]] and not warnings


def test_random_projection(spark):
    df = spark.createDataFrame([(1, "the quick brown fox"), (2, "the quick brown fix"), (3, "zzz unrelated text"), (4, "")], "id int, t string")
    v = {r.id: r.v for r in df.select("id", encode.encode("t", encode.RandomProjection(64)).alias("v")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert abs(dot(1, 1) - 1) < 1e-5 and dot(1, 2) > dot(1, 3) + 0.2 and not any(v[4])
    got = spark.createDataFrame([("क",), ("abc",)], "w string").select("w", T.fnv1a("w", encode.BUCKETS).alias("b")).collect()
    assert all(r.b == encode.bucket(r.w) for r in got)


def test_search_expressions():
    assert retrieve.parse_search('"a b" c OR d AND e OR') == [[["a", "b"], ["c"]], [["d"], ["e"]]]
    assert retrieve.parse_search(' "" ') == []
