"""All queries over the reference operators, by name, and DuckDB SQL for them.

Roles of the tables: documents are letters (lang the department, source the type, the
first line the subject), benchmark texts are requests, conversations are drafting
exchanges, embeddings dense vectors. Hindi operators run on rows of ``fixtures``; their
SQL states the values that were worked out by hand.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, draft, fields, fonts, gold, postings, retrieve, segment, store, templates
from ..sources import archive
from ..streaming import ingest
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


class Long(int):
    """A number that SQL states as BIGINT, as counts are."""


def _values(rows: list[tuple], columns: str) -> str:
    """SELECT over VALUES, for expected results stated by hand."""

    def lit(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        if isinstance(x, Long):
            return f"{int(x)}::BIGINT"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


# --- store -------------------------------------------------------------------
_TRUST_SQL = r"SELECT doc_id, text, lang, source, n_chars, (10000 * length(regexp_replace(text, '[^\p{L}]', '', 'g'))) // greatest(length(text), 1) / 10000.0 AS trust FROM documents"
_SCORED_SQL = f"SELECT *, CASE WHEN trust >= 0.8 THEN 'index' WHEN trust >= 0.6 THEN 'review' ELSE 'quarantine' END AS verdict, CASE WHEN contains(text, chr(10)) THEN 'letter' END AS form FROM ({_TRUST_SQL})"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """documents with trust (share of letters, to four places), verdict and form."""
    docs = _t(spark, d, "documents").withColumn("_l", F.regexp_count("text", F.lit(r"\p{L}"))).withColumn("trust", F.expr("(10000L * _l) div greatest(length(text), 1)") / F.lit(10000.0)).drop("_l")
    cuts, rest, strict = T.SEGMENT_CUTS
    return docs.withColumn("verdict", T.bucket("trust", cuts, rest, strict)).withColumn("form", F.when(F.contains("text", F.lit("\n")), "letter"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM documents GROUP BY 2")
def dedupe_by_hash(spark, d):
    return store.first_by_hash(_t(spark, d, "documents"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM documents i WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text = i.text) GROUP BY 2")
def dedupe_anti_existing(spark, d):
    docs = _t(spark, d, "documents")
    return store.insert_if_new(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 9 ELSE l.quality END AS quality, CASE WHEN l.doc_id IS NULL THEN 9 ELSE l.toxic END AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def refresh_upsert(spark, d):
    letters = _t(spark, d, "documents").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return store.refresh(letters, _t(spark, d, "labels"), "doc_id", ["quality", "toxic"])


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS department, source AS letter_type FROM documents d LEFT JOIN labels USING (doc_id)")
def label_update_coalesce(spark, d):
    letters = _t(spark, d, "documents").select("doc_id", F.col("lang").alias("department"), F.col("source").alias("letter_type"))
    new = _t(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("department"))
    return store.label_where_null(letters, new, "doc_id", ["department"])


@query(f"SELECT count(*) AS letters, round(avg(trust), 4) AS avg_trust, round(avg(n_chars), 4) AS avg_n_chars FROM ({_SCORED_SQL})")
def corpus_stats(spark, d):
    return store.corpus_stats(_scored(spark, d), ["trust", "n_chars"])


@query(f"SELECT verdict, count(*) AS n FROM ({_SCORED_SQL}) GROUP BY 1")
def counts_by_verdict(spark, d):
    return store.counts_by(_scored(spark, d), "verdict")


@query(f"SELECT coalesce(form, '?') AS form, count(*) AS n FROM ({_SCORED_SQL}) GROUP BY 1")
def counts_by_form(spark, d):
    return store.counts_by(_scored(spark, d), "form")


@query(f"SELECT doc_id, trust, verdict FROM ({_SCORED_SQL}) WHERE verdict <> 'index' ORDER BY trust, doc_id LIMIT 50")
def quarantine_topn(spark, d):
    return store.quarantined(_scored(spark, d)).select("doc_id", "trust", "verdict")


@query(f"SELECT doc_id, trust FROM ({_SCORED_SQL}) WHERE trust >= 0.6 AND lang = 'en' AND source = 'src3' AND doc_id NOT IN (3, 23, 43)")
def filters_compose(spark, d):
    return _scored(spark, d).where(store.keep(0.6, "en", "src3", (3, 23, 43), ("trust", "lang", "source", "doc_id"))).select("doc_id", "trust")


@query("SELECT doc_id, coalesce(text, '')[1:160] AS preview FROM documents")
def preview(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 160).alias("preview"))


@query("SELECT DISTINCT lang AS department FROM documents WHERE lang IS NOT NULL")
def distinct_labels(spark, d):
    return _t(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("department")).distinct().orderBy("department")


@query("SELECT lang, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / sum(sum(length(text))) OVER (), 4) AS share FROM documents GROUP BY lang")
def chars_by_group_share(spark, d):
    return store.share_by(_t(spark, d, "documents"), "lang", F.length("text"), "chars")


@query("""SELECT lang, n, x[least(n - 1, floor(n * 0.05::DOUBLE)::BIGINT) + 1] AS p05, x[least(n - 1, floor(n * 0.1::DOUBLE)::BIGINT) + 1] AS p10, x[least(n - 1, floor(n * 0.5::DOUBLE)::BIGINT) + 1] AS p50,
  x[least(n - 1, floor(n * 0.95::DOUBLE)::BIGINT) + 1] AS p95, x[n] AS max FROM (SELECT lang, count(*) n, list_sort(list(n_chars)) x FROM documents GROUP BY lang)""")
def percentile_index(spark, d):
    return store.index_percentiles(_t(spark, d, "documents"), "lang", "n_chars", {"p05": 0.05, "p10": 0.1, "p50": 0.5, "p95": 0.95})


@query("SELECT lang, source, x[n // 2 + 1] AS median FROM (SELECT lang, source, count(*) n, list_sort(list(n_chars)) x FROM documents GROUP BY ALL)")
def upper_median(spark, d):
    return templates.upper_median(_t(spark, d, "documents"), ["lang", "source"], "n_chars", "median")


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def delete_by_id(spark, d):
    return store.with_hash(store.delete(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")).select("doc_id", "text_hash")


@query("SELECT doc_id, lang AS department, CAST(NULL AS VARCHAR) AS letter_number, CAST(NULL AS DOUBLE) AS trust FROM documents")
def migrate_schema(spark, d):
    return store.migrate(_t(spark, d, "documents").select("doc_id", F.col("lang").alias("department")), {"department": "string", "letter_number": "string", "trust": "double"})


@query("SELECT d.doc_id, sha256(coalesce(CASE WHEN l.quality = 0 THEN d.text || '!' END, d.text)) AS text_hash FROM documents d LEFT JOIN labels l USING (doc_id)")
def correct_letters(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    fixes = docs.join(_t(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id").select("doc_id", F.concat("text", F.lit("!")).alias("text"))
    return store.correct(store.with_hash(docs), fixes).select("doc_id", "text_hash")


# --- scalar text -------------------------------------------------------------
@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x{00A0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def ws_normalise(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.normalise("text").cast("binary")).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\s+([,;:।॥)\]])', '\1', 'g'), '([,;:।])([\x{0900}-\x{097F}A-Za-z])', '\1 \2', 'g')) AS digest FROM documents")
def punct_tidy(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.tidy_punctuation("text").cast("binary")).alias("digest"))


@query(_values([(i, r, n) for i, _, r, n in X.VISARGA], "id, text, n"))
def visarga_repair(spark, d):
    rows = _rows(spark, [r[:2] for r in X.VISARGA], "id int, raw string")
    text, n = T.visarga_to_colon("raw")
    return rows.select("id", text.alias("text"), n.alias("n"))


_MIXED_SQL = "translate(text, 'aeoiu', 'अएओइउ')"


@query(rf"""SELECT doc_id, round(CASE WHEN letters = 0 THEN 0 ELSE deva / letters::DOUBLE END, 9) AS ratio, letters FROM (SELECT doc_id, length(regexp_replace({_MIXED_SQL}, '[^\p{{L}}]', '', 'g')) AS letters,
  length(regexp_replace({_MIXED_SQL}, '[^अएओइउ]', '', 'g')) AS deva FROM documents)""")
def script_ratio(spark, d):
    """Of texts whose vowels are Devanagari letters."""
    mixed = F.translate("text", "aeoiu", "अएओइउ")
    return _t(spark, d, "documents").select("doc_id", F.round(T.script_ratio(mixed), 9).alias("ratio"), F.regexp_count(mixed, F.lit(r"\p{L}")).cast("long").alias("letters"))


@query(_values([(i, v) for i, _, v in X.BROKEN], "id, violations"))
def rule_violations(spark, d):
    pairs = F.transform(F.array_sort(F.map_entries(T.violations("text"))), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return _rows(spark, [r[:2] for r in X.BROKEN], "id int, text string").select("id", F.array_join(pairs, ",").alias("violations"))


@query(_values([(i, s) for i, _, s in X.SCORED], "id, score"))
def quality_score(spark, d):
    return _rows(spark, [r[:2] for r in X.SCORED], "id int, text string").select("id", F.round(T.quality("text") * 10000).cast("int").alias("score"))


@query(f"SELECT doc_id, CASE WHEN trust >= 0.85 THEN 'clean' WHEN trust >= 0.6 THEN 'review' ELSE 'quarantine' END AS quality, CASE WHEN trust > 0.7 THEN 'failed' WHEN trust > 0.3 THEN 'heavy' WHEN trust > 0.1 THEN 'edited' ELSE 'as-drafted' END AS effort FROM ({_TRUST_SQL})")
def verdict_bucket(spark, d):
    (qc, qr, qs), (ec, er, es) = T.QUALITY_CUTS, T.EFFORT_CUTS
    return _scored(spark, d).select("doc_id", T.bucket("trust", qc, qr, qs).alias("quality"), T.bucket("trust", ec, er, es).alias("effort"))


_TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Mn}\p{Mc}\p{Co}]+')"
_VOCAB_SQL = f"SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct({_TOKENS_SQL})) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 3"


def _vocabulary(spark, d):
    words = _t(spark, d, "documents").select(F.explode(F.array_distinct(T.tokens("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")


@query(_VOCAB_SQL)
def vocab_df(spark, d):
    return _vocabulary(spark, d)


@query(f"SELECT doc_id, round(count(v.word) / count(*), 6) AS hit_rate FROM (SELECT doc_id, unnest({_TOKENS_SQL}) AS word FROM documents) LEFT JOIN ({_VOCAB_SQL}) v USING (word) GROUP BY 1")
def vocab_hit_rate(spark, d):
    return postings.hit_rates(postings.load(spark, _indexed(spark, d))[0], 3).select(F.col("doc").alias("doc_id"), F.round("hit_rate", 6).alias("hit_rate"))


@query("SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(text, i, 3))) AS gram FROM documents) GROUP BY 1")
def char_ngrams_count(spark, d):
    rows = _t(spark, d, "documents").select(F.split("text", "").alias("ch")).where("size(ch) >= 3")
    return rows.selectExpr("ch", "explode(sequence(0, size(ch) - 3)) i").groupBy(F.expr("concat(ch[i], ch[i + 1], ch[i + 2]) gram")).agg(F.count("*").alias("n"))


@query(f"""SELECT word, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(word, ''), lambda c: unicode(c)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) % 32768 AS INTEGER) AS bucket
  FROM (SELECT DISTINCT unnest({_TOKENS_SQL}) AS word FROM documents)""")
def fnv_bucket(spark, d):
    words = _t(spark, d, "documents").select(F.explode(T.tokens("text")).alias("word")).distinct()
    return words.select("word", T.fnv1a("word", 1 << 15).alias("bucket"))


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS_SQL} AS t FROM documents)")
def word_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.tokens("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


_TERMS_SQL = "list_filter(regexp_extract_all(text, '[ऀ-ॣ०-९ॲ-ॿA-Za-z0-9]+'), lambda w: length(w) > 1)[1:24]"


@query(f"SELECT item_id, array_to_string({_TERMS_SQL}, ' ') AS terms FROM benchmark")
def query_terms(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.array_join(T.query_terms("text"), " ").alias("terms"))


_CANON_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '[-–—_.░]{3,}', '░', 'g'), '[0-9०-९]+', '#', 'g'), '\s+', '', 'g'), '^[ ,।;:.]+|[ ,।;:.]+$', '', 'g')"


@query(f"SELECT DISTINCT md5({_CANON_SQL}) AS canon FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def canonical_line(spark, d):
    lines = _t(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line")).distinct()
    return lines.select(F.md5(T.canonical_line("line").cast("binary")).alias("canon")).distinct()


@query("SELECT doc_id, md5(translate(text, '०१२३४५६७८९', '0123456789')) AS digest FROM documents")
def digit_fold(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.digits("text").cast("binary")).alias("digest"))


@query(_values([(i, o) for i, _, o in X.DATES], "id, iso"))
def date_parse(spark, d):
    return _rows(spark, [r[:2] for r in X.DATES], "id int, raw string").select("id", T.iso_date("raw").alias("iso"))


@query(r"""SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '[ऀ-ॣ०-९ॲ-ॿ]+')) * 1.97::DOUBLE + len(regexp_extract_all(text, '[A-Za-z]+')) * 1.3::DOUBLE + len(regexp_extract_all(text, '[0-9]')) / 2
  + len(regexp_extract_all(text, '[^\p{L}\p{N}_\s\x{00A0}]')) * 0.5::DOUBLE) AS INTEGER) + 8 AS tokens FROM documents""")
def token_estimate(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


_ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"


@query(f"SELECT conv_id AS id, levenshtein(arg_min({_ASCII}, turn), arg_max({_ASCII}, turn))::INTEGER AS distance FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def edit_distance(spark, d):
    """Between the first and last turn of each conversation, of their ASCII characters, as DuckDB's distance counts bytes."""
    ascii_ = F.regexp_replace("text", "[^ -~]", "")
    ends = _t(spark, d, "conversations").where("text is not null").groupBy(F.col("conv_id").alias("id")).agg(F.min_by(ascii_, "turn").alias("a"), F.max_by(ascii_, "turn").alias("b"))
    return ends.select("id", F.levenshtein("a", "b").alias("distance"))


def _exchanges(spark, d):
    """(id, draft_text, text): each conversation's first and last assistant turn, as draft and dispatched text."""
    turns = _t(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("draft_text"), F.max_by("text", "turn").alias("text"), F.count("*").alias("n"))
    return turns.select(F.col("conv_id").alias("id"), "draft_text", F.when(F.col("n") > 1, F.col("text")).alias("text"))


@query()
def effort_score(spark, d):
    e = _exchanges(spark, d)
    return store.record_dispatch(e.select("id", "draft_text"), e.where("text is not null").select("id", "text")).select("id", F.round("effort", 6).alias("effort"))


_EFFORT = "round(length(text) / 5000.0::DOUBLE, 4)"


@query(f"""WITH e AS (SELECT {_EFFORT} v FROM conversations WHERE role = 'assistant'), s AS (SELECT list_sort(list(v)) x, count(*) n FROM e),
m AS (SELECT count(*) FILTER (v > 0.7) failed, count(*) FILTER (v <= 0.1) as_drafted FROM e)
SELECT n, (x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2 AS median, CASE WHEN n >= 10 THEN x[round_even(0.9::DOUBLE * n, 0)::BIGINT] ELSE x[n] END AS p90, failed, as_drafted FROM s, m""")
def effort_summary(spark, d):
    """Of the lengths of all assistant turns, as shares of 5,000 characters, in the effort's place."""
    return store.effort_summary(_t(spark, d, "conversations").where("role = 'assistant'").select(F.round(F.length("text") / 5000.0, 4).alias("effort")))


@query("""SELECT conv_id AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), ''), '[0-9०-९]{2,}'),
  lambda t: NOT list_contains(regexp_extract_all(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'assistant'), ''), '[0-9०-९]{2,}'), t)))), ',') AS numbers FROM conversations GROUP BY conv_id""")
def unsupported_numbers(spark, d):
    said = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    c = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(said(F.col("role") == "assistant").alias("body"), said(F.col("role") != "assistant").alias("asked"))
    return c.select("id", F.array_join(T.unsupported_numbers("body", "asked"), ",").alias("numbers"))


@query(_values([(i, t, r) for i, _, t, r in X.CLEANED], "id, text, removed"))
def clean_body(spark, d):
    text, removed = T.clean_body("raw")
    return _rows(spark, [r[:2] for r in X.CLEANED], "id int, raw string").select("id", text.alias("text"), F.array_join(removed, ";").alias("removed"))


# --- retrieval ---------------------------------------------------------------
def _letters(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "lang", "source")


def _requests(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")


def _shared(spark) -> str:
    """The cluster's shared folder; on one machine, where none is set, a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


_INDEXES: dict[tuple, str] = {}


def _indexed(spark, d) -> str:
    """The folder of the stored postings of a data folder's documents, which are built once a session."""
    docs = _letters(spark, d)
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _INDEXES:
        folder = f"{_shared(spark)}/postings-{uuid.uuid4().hex}"
        postings.build(docs, folder)
        _INDEXES[key] = folder
    return _INDEXES[key]


def _bm25(spark, d, queries, k, own=True):
    return retrieve.bm25_scores(*postings.load(spark, _indexed(spark, d)), queries, k=k, own=own)


_BM25_WITH = f"""tok AS (SELECT doc_id doc, {_TOKENS_SQL} t FROM documents), st AS (SELECT count(*) n, avg(len(t)) a FROM tok), lens AS (SELECT doc, len(t) l FROM tok),
post AS (SELECT doc, term, count(*) tf FROM (SELECT doc, unnest(t) term FROM tok) GROUP BY ALL), dfs AS (SELECT term, count(*) df FROM post GROUP BY 1)"""


def _bm25_sql(source: str) -> str:
    return f"""qt AS (SELECT query, lower(term) term, count(*) times FROM (SELECT query, unnest({_TERMS_SQL}) term FROM ({source})) GROUP BY ALL),
bm AS (SELECT query, doc, round(sum(times * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 6) score
  FROM qt JOIN dfs USING (term) JOIN post USING (term) JOIN lens USING (doc), st GROUP BY ALL)"""


_ASKED = "SELECT item_id query, text FROM benchmark"


@query(f"WITH {_BM25_WITH}, {_bm25_sql(_ASKED)} SELECT query, doc, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) rank FROM bm) WHERE rank <= 5")
def bm25_topk(spark, d):
    return retrieve.top(_bm25(spark, d, _requests(spark, d), 5), 5)


_REFRESHED = """(SELECT CASE WHEN doc_id % 7 = 1 THEN doc_id + 1000000 ELSE doc_id END doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' changed word' ELSE text END AS text
  FROM documents WHERE doc_id % 7 <> 2)"""


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest({_TOKENS_SQL}) term FROM {_REFRESHED}) GROUP BY ALL) GROUP BY 1")
def index_refresh(spark, d):
    """The stored postings after letters were removed, moved to new ids and changed, without indexing the others anew."""
    docs, folder = _letters(spark, d).select("doc", "text"), _indexed(spark, d)
    new = F.when(F.col("doc") % 5 == 0, F.concat("text", F.lit(" changed word"))).otherwise(F.col("text"))
    moved = docs.where("doc % 7 = 1").select((F.col("doc") + 1_000_000).alias("doc"), new.alias("text"))
    changed = docs.where("doc % 5 = 0 and doc % 7 <> 1 and doc % 7 <> 2").select("doc", new.alias("text"))
    to = f"{_shared(spark)}/postings-{uuid.uuid4().hex}"
    postings.refresh(spark, folder, changed.unionByName(moved), docs.where("doc % 7 in (1, 2)"), to)
    return postings.terms(postings.load(spark, to)[0])


@query(f"""WITH {_BM25_WITH}, {_bm25_sql(_ASKED)}, raw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) r FROM bm) WHERE r <= 40)
SELECT query, doc, score, rank FROM (SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) rank FROM raw JOIN documents ON doc = doc_id WHERE lang = 'en') WHERE rank <= 5""")
def bm25_filtered(spark, d):
    return retrieve.bm25_filtered(_letters(spark, d), _requests(spark, d), F.col("lang") == "en", 5, found=_bm25(spark, d, _requests(spark, d), 40))


def _with_subject(docs):
    first = F.substring_index("text", "\n", 1)
    return docs.select("doc", F.concat_ws(" ", first, first, F.col("text")).alias("text"))


def _grams_sql(source: str, key: str, lo: int, hi: int, most: int) -> str:
    each = " UNION ALL ".join(f"SELECT {key}, unnest(list_transform(range(1, greatest(length(t) - {n - 2}, 1)), lambda i: substr(t, i, {n}))) gram FROM (SELECT {key}, substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, {most}) t FROM ({source}))" for n in range(lo, hi + 1))
    return f"SELECT {key}, gram, count(*) c FROM ({each}) GROUP BY ALL"


_SUBJECTS = "SELECT doc_id doc, concat(split_part(text, chr(10), 1), ' ', split_part(text, chr(10), 1), ' ', text) text FROM documents"
_FNV_SQL = "CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({}, ''), lambda c: unicode(c)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) % 32768 AS INTEGER)"


def _buckets_sql(grams: str, key: str) -> str:
    """Counts of n-grams as counts of their buckets."""
    return f"SELECT {key}, bucket gram, sum(c)::BIGINT c FROM ({grams}) JOIN (SELECT gram, {_FNV_SQL.format('gram')} bucket FROM (SELECT DISTINCT gram FROM ({grams}))) USING (gram) GROUP BY ALL"


_TFIDF_WITH = f"""g0 AS ({_grams_sql(_SUBJECTS, 'doc', 3, 5, 1500)}), g AS ({_buckets_sql('FROM g0', 'doc')}), idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 idf FROM g GROUP BY 1),
w0 AS (SELECT doc, gram, (1 + ln(c)) * idf w FROM g JOIN idf USING (gram)), nd AS (SELECT doc, sqrt(sum(w * w)) nn FROM w0 GROUP BY 1), dw AS (SELECT doc, gram, w / nn w FROM w0 JOIN nd USING (doc))"""
_TFIDF_Q = f"""gq0 AS ({_grams_sql(_ASKED, 'query', 3, 5, 1500)}), gq AS ({_buckets_sql('FROM gq0', 'query')}), q0 AS (SELECT query, gram, (1 + ln(c)) * idf w FROM gq JOIN idf USING (gram)), nq AS (SELECT query, sqrt(sum(w * w)) nn FROM q0 GROUP BY 1),
tf AS (SELECT query, doc, round(sum(dw.w * q0.w / nn), 6) score FROM q0 JOIN nq USING (query) JOIN dw USING (gram) GROUP BY ALL)"""


@query(f"WITH {_TFIDF_WITH} SELECT doc, count(*) AS grams, round(max(w), 6) AS most, round(sum(w), 4) AS total FROM dw GROUP BY 1")
def tfidf_weights(spark, d):
    docs = _with_subject(_letters(spark, d))
    w = retrieve.tfidf_weights(docs, retrieve.idf(docs))
    return w.where("size(w) > 0").select("doc", F.size("w").cast("long").alias("grams"), F.round(F.array_max("w"), 6).alias("most"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH {_TFIDF_WITH}, {_TFIDF_Q} SELECT query, doc, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) rank FROM tf) WHERE rank <= 5")
def tfidf_topk(spark, d):
    return retrieve.top(retrieve.tfidf(_with_subject(_letters(spark, d)), _requests(spark, d), 5), 5)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings), s AS (SELECT q.vec_id query, c.vec_id doc, round(list_dot_product(c.v, q.v) / (sqrt(list_dot_product(c.v, c.v)) * sqrt(list_dot_product(q.v, q.v))), 6) score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id) SELECT query, doc, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) rank FROM s) WHERE rank <= 5""")
def dense_topk(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    return retrieve.dense(e, e.where("doc % 50 = 0").withColumnRenamed("doc", "query"), 5)


_FUSED_SQL = """pools AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) rank FROM bm QUALIFY rank <= 30 UNION ALL SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) rank FROM tf QUALIFY rank <= 30),
fused AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) score FROM pools GROUP BY ALL)"""


@query(f"WITH {_BM25_WITH}, {_bm25_sql(_ASKED)}, {_TFIDF_WITH}, {_TFIDF_Q}, {_FUSED_SQL} SELECT * FROM fused")
def rrf_fuse(spark, d):
    docs, q = _letters(spark, d), _requests(spark, d)
    return retrieve.rrf({"bm25": retrieve.top(_bm25(spark, d, q, 30), 30), "tfidf": retrieve.top(retrieve.tfidf(_with_subject(docs), q, 30), 30)}).drop("ranks")


@query(f"""WITH {_BM25_WITH}, {_bm25_sql(_ASKED)}, {_TFIDF_WITH}, {_TFIDF_Q}, {_FUSED_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) rank FROM fused)
SELECT query, doc, score, rank, lang, source FROM r JOIN documents ON doc = doc_id WHERE rank <= 5""")
def hybrid_search(spark, d):
    docs, q = _letters(spark, d), _requests(spark, d)
    fused = retrieve.rrf({"bm25": retrieve.top(_bm25(spark, d, q, 30), 30), "tfidf": retrieve.top(retrieve.tfidf(_with_subject(docs), q, 30), 30)})
    return retrieve.top(fused, 5).join(docs.select("doc", "lang", "source"), "doc").select("query", "doc", "score", "rank", "lang", "source")


# --- evaluation: the stated queries are documents whose id 50 divides --------
_EVAL_SQL = "SELECT doc_id query, split_part(text, chr(10), 1) text FROM documents d WHERE doc_id % 50 = 0 AND length(split_part(text, chr(10), 1)) >= 12 AND (SELECT count(*) FROM documents e WHERE e.lang = d.lang AND e.source = d.source) >= 5"
_CELL = "lang || '/' || source"


def _eval_queries(spark, d):
    docs = _letters(spark, d)
    big = docs.groupBy("lang", "source").agg(F.count("*").alias("n")).where("n >= 5")
    q = docs.where("doc % 50 = 0").withColumn("text", F.substring_index("text", "\n", 1)).where("length(text) >= 12")
    return q.join(big, ["lang", "source"]).select(F.col("doc").alias("query"), "text")


@query("SELECT doc_id AS doc, count(*) OVER (PARTITION BY lang, source) - 1 AS mates FROM documents")
def cell_mates(spark, d):
    docs = _letters(spark, d)
    n = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return docs.join(n, ["lang", "source"]).select("doc", (F.col("n") - 1).alias("mates"))


_KNOWN_SQL = f"""WITH {_BM25_WITH}, {_bm25_sql(_EVAL_SQL)}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) rank FROM bm QUALIFY rank <= 5)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall5, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr
FROM ({_EVAL_SQL}) q LEFT JOIN r ON q.query = r.query AND r.doc = q.query"""


@query(_KNOWN_SQL)
def eval_known_item(spark, d):
    q = _eval_queries(spark, d)
    return retrieve.known_item(retrieve.top(_bm25(spark, d, q, 5), 5), q)


@query(f"""WITH {_BM25_WITH}, {_bm25_sql(_EVAL_SQL)}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) rank FROM bm WHERE query <> doc QUALIFY rank <= 5), p AS (SELECT query, avg(CASE WHEN a.lang = b.lang AND a.source = b.source THEN 1.0 ELSE 0.0 END) p
FROM r JOIN documents a ON r.doc = a.doc_id JOIN documents b ON r.query = b.doc_id GROUP BY 1) SELECT count(*) AS n, round(avg(p), 6) AS p5 FROM p""")
def eval_same_cell_p5(spark, d):
    docs = _letters(spark, d)
    found = _bm25(spark, d, _eval_queries(spark, d), 5, own=False)
    return retrieve.same_cell(retrieve.top(found, 5), docs.select("doc", F.concat_ws("/", "lang", "source").alias("cell")))


@query(f"SELECT *, round(sqrt(recall5 * (1 - recall5) / n), 6) AS se FROM ({_KNOWN_SQL})")
def eval_stderr(spark, d):
    return retrieve.standard_error(eval_known_item(spark, d), "recall5")


@query("""WITH w AS (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') w FROM benchmark),
k AS (SELECT item_id, w, list_sort(list_transform(list_sort(list_transform(range(len(w)), lambda i: {'h': md5(item_id || '-' || i), 'i': i}))[1:greatest(2, len(w) // 2)], lambda x: x.i)) p FROM w)
SELECT item_id AS query, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(p, lambda i: w[i + 1]), ' ') END AS text FROM k""")
def degrade_queries(spark, d):
    return retrieve.degrade(_requests(spark, d)).select("query", "text")


@query(f"""WITH p AS (SELECT doc_id doc, row_number() OVER (ORDER BY doc_id) - 1 pos FROM documents),
j AS (SELECT query, j, ((query % 1000003 + 1) * 7919 + j * 104729 + ((query % 1009 + 3) * j * j * 31) % 611953) % (SELECT count(*) FROM documents) pos FROM ({_EVAL_SQL}) q, range(24) t(j)),
m AS (SELECT query, doc, min(j) j FROM j JOIN p USING (pos) WHERE doc <> query GROUP BY ALL) SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY j) AS INTEGER) rank FROM m QUALIFY rank <= 5""")
def random_baseline(spark, d):
    return retrieve.random_baseline(_letters(spark, d), _eval_queries(spark, d))


@query()
def eval_sweep(spark, d):
    """BM25, TF-IDF and their fusion on the same queries; each figure has SQL of its own above."""
    docs, q = _letters(spark, d), _eval_queries(spark, d)
    a, b = (x.persist() for x in (_bm25(spark, d, q, 30), retrieve.tfidf(_with_subject(docs), q, 30)))  # each is read several times
    fused = retrieve.rrf({"bm25": retrieve.top(a, 30), "tfidf": retrieve.top(b, 30)}).drop("ranks")
    return retrieve.sweep({"bm25": a, "tfidf": b, "rrf": fused}, q, docs.select("doc", F.concat_ws("/", "lang", "source").alias("cell")))


@query(f"""WITH {_BM25_WITH}, {_bm25_sql("SELECT 0 query, 'apache license version the thing' AS text")}, hit AS (SELECT doc FROM tok WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' apache license version ') OR (list_contains(t, 'the') AND list_contains(t, 'thing')))
SELECT doc, score, rank FROM (SELECT doc, score, CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) rank FROM bm JOIN hit USING (doc)) WHERE rank <= 10""")
def fts_search(spark, d):
    return retrieve.search(_letters(spark, d), '"Apache License, Version" OR the thing', 10, index=postings.load(spark, _indexed(spark, d)))


# --- classification ----------------------------------------------------------
def _labelled(spark, d):
    return _letters(spark, d).select("doc", "text", F.col("lang").alias("label"))


_NB_WITH = f"""c AS ({_grams_sql('SELECT doc_id doc, text FROM documents', 'doc', 2, 4, 1200)}), vocab AS (SELECT gram FROM c GROUP BY 1 HAVING count(*) >= 2), lab AS (SELECT doc_id doc, lang AS label FROM documents),
stats AS (SELECT label, gram, sum(c)::BIGINT c FROM c JOIN vocab USING (gram) JOIN lab USING (doc) GROUP BY ALL), pri AS (SELECT label, count(*) n, ln(count(*) / (SELECT count(*) FROM lab)) log_prior FROM lab GROUP BY 1),
cls AS (SELECT label, log_prior, sum(c) + 0.2::DOUBLE * (SELECT count(*) FROM vocab) den FROM stats JOIN pri USING (label) GROUP BY ALL), model AS (SELECT label, gram, ln((c + 0.2::DOUBLE) / den) logp FROM stats JOIN cls USING (label))"""


@query("SELECT lang AS label, count(*) AS n, round(ln(count(*) / sum(count(*)) OVER ()), 9) AS log_prior FROM documents GROUP BY 1")
def nb_fit_priors(spark, d):
    return classify.nb_priors(_labelled(spark, d)).select("label", "n", F.round("log_prior", 9).alias("log_prior"))


@query(f"WITH {_NB_WITH} SELECT label, gram, round(logp, 6) AS logp FROM model")
def nb_fit_likelihood(spark, d):
    docs = _labelled(spark, d)
    return classify.nb_fit(docs, classify.nb_counts(docs))[0].select("label", "gram", F.round("logp", 6).alias("logp"))


@query(f"""WITH {_NB_WITH}, known AS (SELECT doc, gram, c FROM c JOIN vocab USING (gram)), m AS (SELECT doc, sum(c)::DOUBLE m FROM known GROUP BY 1), dc AS (SELECT l.doc, m, label, log_prior, ln(0.2::DOUBLE / den) de FROM (SELECT DISTINCT doc FROM c) l LEFT JOIN m USING (doc), cls),
x AS (SELECT doc, label, sum(known.c * (logp - ln(0.2::DOUBLE / den))) s FROM known JOIN model USING (gram) JOIN cls USING (label) GROUP BY ALL),
sc AS (SELECT doc, label, round((log_prior + coalesce(m, 0) * de + coalesce(s, 0)) / greatest(coalesce(m, 0), 1), 9) score FROM dc LEFT JOIN x USING (doc, label))
SELECT doc, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, label) r FROM sc) WHERE r = 1""")
def nb_predict(spark, d):
    docs = _labelled(spark, d)
    counts = classify.nb_counts(docs)
    model, classes = classify.nb_fit(docs, counts)
    return classify.nb_predict(counts, model, classes).select("doc", "label", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id AS doc, CASE WHEN count(*) OVER (PARTITION BY {_CELL}) < 10 THEN 'other' ELSE {_CELL} END AS label FROM documents")
def fold_rare(spark, d):
    cells = _letters(spark, d).select("doc", F.concat_ws("/", "lang", "source").alias("label"))
    return classify.fold_rare(cells, "label").select("doc", "label")


@query(f"SELECT count(*) FILTER (n < 10) AS classes, coalesce(sum(n) FILTER (n < 10), 0)::BIGINT AS letters, sum(n)::BIGINT AS total, round(coalesce(sum(n) FILTER (n < 10), 0) / sum(n), 6) AS share FROM (SELECT count(*) n FROM documents GROUP BY {_CELL})")
def coverage_gap(spark, d):
    return classify.coverage_gap(_letters(spark, d).select(F.concat_ws("/", "lang", "source").alias("label")), "label")


@query("SELECT doc_id AS doc, lang AS label, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents")
def cv_folds(spark, d):
    return classify.folds(_labelled(spark, d).select("doc", "label")).select("doc", "label", "fold")


_CV_SQL = f"""WITH c AS ({_grams_sql('SELECT doc_id doc, text FROM documents', 'doc', 2, 4, 1200)}), lab AS (SELECT doc_id doc, lang AS label, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 5 fold FROM documents), fs AS (SELECT unnest(range(5)) f),
tr AS (SELECT f, doc, label FROM lab, fs WHERE fold <> f), df AS (SELECT gram, fold, count(*) k FROM c JOIN lab USING (doc) GROUP BY ALL), dft AS (SELECT gram, sum(k) k FROM df GROUP BY 1),
vocab AS (SELECT f, dft.gram FROM dft CROSS JOIN fs LEFT JOIN df ON df.gram = dft.gram AND fold = f WHERE dft.k - coalesce(df.k, 0) >= 2),
gc AS (SELECT label, fold, gram, sum(c) s FROM c JOIN lab USING (doc) GROUP BY ALL), gt AS (SELECT label, gram, sum(s) s FROM gc GROUP BY ALL),
stats AS (SELECT v.f, gt.label, gt.gram, gt.s - coalesce(gc.s, 0) c FROM gt JOIN vocab v USING (gram) LEFT JOIN gc ON gc.label = gt.label AND gc.gram = gt.gram AND gc.fold = v.f WHERE gt.s - coalesce(gc.s, 0) > 0),
pri AS (SELECT f, label, ln(k / sum(k) OVER (PARTITION BY f)) lp FROM (SELECT f, label, count(*) k FROM tr GROUP BY f, label)), vs AS (SELECT f, count(*) v FROM vocab GROUP BY 1),
cls AS (SELECT s.f, s.label, lp, sum(c) + 0.2::DOUBLE * v den FROM stats s JOIN pri ON pri.f = s.f AND pri.label = s.label JOIN vs ON vs.f = s.f GROUP BY s.f, s.label, lp, v),
known AS (SELECT doc, fold f, c.gram, c FROM c JOIN lab USING (doc) JOIN vocab v ON v.f = fold AND v.gram = c.gram), m AS (SELECT doc, sum(c)::DOUBLE m FROM known GROUP BY 1),
x AS (SELECT doc, s.label, sum(known.c * (ln((s.c + 0.2::DOUBLE) / den) - ln(0.2::DOUBLE / den))) e FROM known JOIN stats s ON s.f = known.f AND s.gram = known.gram JOIN cls ON cls.f = s.f AND cls.label = s.label GROUP BY ALL),
sc AS (SELECT l.doc, l.label truth, cls.label, round((lp + coalesce(m, 0) * ln(0.2::DOUBLE / den) + coalesce(e, 0)) / greatest(coalesce(m, 0), 1), 9) score FROM lab l JOIN cls ON cls.f = l.fold LEFT JOIN m USING (doc) LEFT JOIN x ON x.doc = l.doc AND x.label = cls.label WHERE l.doc IN (SELECT doc FROM c)),
p AS (SELECT doc, truth, label FROM sc QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, label) = 1),
t AS (SELECT truth label, count(*) support, count(*) FILTER (truth = label) hits FROM p GROUP BY 1), u AS (SELECT label, count(*) predicted FROM p GROUP BY 1)
SELECT label, support, coalesce(predicted, 0) AS predicted, hits, round(coalesce(hits / predicted, 0), 6) AS precision, round(hits / support, 6) AS recall, round(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / predicted) * (hits / support) / (hits / predicted + hits / support) END, 6) AS f1 FROM t LEFT JOIN u USING (label)"""


@query(_CV_SQL)
def cv_report(spark, d):
    docs = _labelled(spark, d)
    return classify.report(classify.cross_validate(classify.folds(docs).drop("text"), classify.nb_counts(docs)))


# --- templates ---------------------------------------------------------------
_CELLS = ["lang", "source"]
_LINES_WITH = f"""sizes AS (SELECT lang, source, count(*) n FROM documents GROUP BY ALL HAVING count(*) >= 8), l0 AS (SELECT lang, source, doc_id, string_split(text, chr(10)) p FROM documents JOIN sizes USING (lang, source)),
l1 AS (SELECT lang, source, doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END p FROM l0), l2 AS (SELECT lang, source, doc_id, greatest(len(p), 1) total, unnest(range(len(p))) idx, unnest(p) raw FROM l1),
l3 AS (SELECT lang, source, doc_id, total, idx, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l2), rows_ AS (SELECT *, {_CANON_SQL} canon FROM l3 WHERE length(line) >= 4),
inl AS (SELECT lang, source, canon, count(DISTINCT doc_id) letters FROM rows_ WHERE canon <> '' GROUP BY ALL), found AS (SELECT lang, source, canon, letters, n FROM inl JOIN sizes USING (lang, source) WHERE letters >= greatest(2, floor(n * 0.3::DOUBLE)))"""


def _mined(docs):
    """All lines, those that may be boilerplate, and what is."""
    sizes, rows = templates.cells(docs, _CELLS), templates.lines(docs, _CELLS)
    near = templates.shared(rows, sizes, _CELLS)
    return rows, near, templates.measured(templates.boilerplate(near, sizes, _CELLS))


@query(f"WITH {_LINES_WITH} SELECT * FROM found")
def boilerplate_lines(spark, d):
    return _mined(_t(spark, d, "documents"))[2].select("lang", "source", "canon", "letters", "n")


_MODAL = """modal AS (SELECT lang, source, canon, line AS literal, times FROM (SELECT lang, source, canon, line, count(*) times, min((doc_id, idx)) seen FROM rows_ JOIN found USING (lang, source, canon) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY lang, source, canon ORDER BY times DESC, seen, line) = 1)"""


@query(f"WITH {_LINES_WITH}, {_MODAL} SELECT * FROM modal")
def modal_literal(spark, d):
    _, near, found = _mined(_t(spark, d, "documents"))
    return templates.modal_literal(near, found, _CELLS)


_POS_WITH = f"{_LINES_WITH}, firsts AS (SELECT lang, source, canon, doc_id, min(round(idx / total, 9)) a FROM rows_ JOIN found USING (lang, source, canon) GROUP BY ALL), pos AS (SELECT lang, source, canon, list_sort(list(a))[count(*) // 2 + 1] pos FROM firsts GROUP BY ALL)"


@query(f"WITH {_POS_WITH} SELECT * FROM pos")
def line_position(spark, d):
    _, near, found = _mined(_t(spark, d, "documents"))
    return templates.positions(near, found, _CELLS)


def _roles(docs):
    rows, near, found = _mined(docs)
    return rows, templates.measured(templates.roles(found, templates.modal_literal(near, found, _CELLS), templates.positions(near, found, _CELLS), _CELLS))


_FRAMED = "(SELECT doc_id, lang, source, 'कार्यालय जिला पदाधिकारी' || chr(10) || 'पत्रांक ' || doc_id || chr(10) || text || chr(10) || 'विश्वासभाजन' AS text FROM documents)"
#: Its landmarks: the office's line is of rank 0, the letter number's of rank 1, the closing's of rank 9.
#: In a canonical line marks are in order, so the anusvara comes before the vowel sign.
_FRAMED_SQL = f"""WITH {_POS_WITH.replace('FROM documents', f'FROM {_FRAMED}').replace(f'{_CANON_SQL} canon', f"replace({_CANON_SQL}, 'ां', 'ंा') canon")}, {_MODAL},
rl AS (SELECT *, CASE WHEN literal = 'कार्यालय जिला पदाधिकारी' THEN 0 WHEN literal LIKE 'पत्रांक %' THEN 1 WHEN literal = 'विश्वासभाजन' THEN 9 END role FROM pos JOIN modal USING (lang, source, canon)),
mk AS (SELECT lang, source, role r, pos p FROM rl WHERE role IS NOT NULL),
nr AS (SELECT l.lang, l.source, l.canon, arg_min(r, (round(abs(p - l.pos), 9), r)) near, max(p) FILTER (r = 9) closing_pos FROM rl l JOIN mk USING (lang, source) GROUP BY ALL)
SELECT lang, source, canon, pos, coalesce(role, near)::INTEGER AS rank, length(literal) > 120 OR (role IS NULL AND near >= 9 AND pos < closing_pos) AS is_body FROM rl JOIN nr USING (lang, source, canon)"""


@query(_FRAMED_SQL)
def skeleton_roles(spark, d):
    """Of the documents between an office's line, a letter number and a closing: the rank of the nearest landmark."""
    docs = _t(spark, d, "documents").withColumn("text", F.concat(F.lit("कार्यालय जिला पदाधिकारी\nपत्रांक "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\nविश्वासभाजन")))
    return _roles(docs)[1].select("lang", "source", "canon", "pos", "rank", "is_body")


@query(f"WITH {_LINES_WITH}, {_MODAL}, hit AS (SELECT lang, source, doc_id, avg(CASE WHEN f.literal IS NULL OR length(f.literal) > 120 THEN 0 ELSE 1 END) s FROM rows_ r LEFT JOIN modal f USING (lang, source, canon) GROUP BY ALL) SELECT lang, source, count(*) AS letters, round(avg(s), 6) AS coverage FROM hit GROUP BY ALL")
def skeleton_coverage(spark, d):
    rows, kept = _roles(_t(spark, d, "documents"))
    return templates.coverage(rows, kept, _CELLS)


def _cell_of_letters(spark):
    """Eight letters of one cell, each with its own body."""
    body = ["पहला", "दूसरा", "तीसरा", "चौथा", "पाँचवाँ", "छठा", "सातवाँ", "आठवाँ"]
    return _rows(spark, [(i, "क", "ख", "\n".join([*X.LETTER_1[:2], *X.LETTER_1[5:7], f"यह {b} निवेदन है कि कार्य समय पर पूरा हो।", *X.LETTER_1[8:]])) for i, b in enumerate(body)], "doc_id long, lang string, source string, text string")


@query(_values([("दिनांक", Long(8)), ("पत्रांक", Long(8))], "label, times"))
def blank_labels(spark, d):
    letters = _cell_of_letters(spark)
    return templates.blank_labels(letters, templates.cells(letters, _CELLS), _CELLS).select("label", "times")


@query(_values([(0, X.LETTER_1[0], False), (1, X.LETTER_1[1], False), (5, X.LETTER_1[5], False), (7, X.LETTER_1[6], False), (9, X.LETTER_1[8], False), (9, X.LETTER_1[9], False)], "rank, literal, is_body"))
def skeleton_landmarks(spark, d):
    letters = _cell_of_letters(spark)
    rows = templates.lines(letters, _CELLS)
    found = templates.boilerplate(rows, templates.cells(letters, _CELLS), _CELLS)
    return templates.roles(found, templates.modal_literal(rows, found, _CELLS), templates.positions(rows, found, _CELLS), _CELLS).select("rank", "literal", "is_body")


# --- segmentation ------------------------------------------------------------
@query(_values([(i, a) for i, _, a in X.TAGGED], "id, tags"))
def tag_lines(spark, d):
    return _rows(spark, [r[:2] for r in X.TAGGED], "id int, line string").select("id", F.array_join(segment.line_tags(F.col("line")), ",").alias("tags"))


def _split(spark):
    return segment.segment(_rows(spark, X.DOCUMENTS, "doc_id int, text string"))


@query(_values([(1, 0, 0, 11, "file-start"), (1, 1, 11, 22, "header-after-close"), (2, 0, 0, 6, "file-start"), (3, 0, 0, 1, "file-start"), (5, 0, 0, 7, "file-start"), (5, 1, 7, 17, "repeated-subject"), (6, 0, 0, 10, "file-start"), (7, 0, 0, 11, "file-start")], "doc_id, seq, start_line, end_line, opened_by"))
def segment_boundaries(spark, d):
    return _split(spark).select("doc_id", "seq", "start_line", "end_line", "opened_by")


@query(_values([(1, 1, 2, 1, 1), (1, 0, 1, 0, 1), (5, 1, 1, 0, 1), (5, 0, 1, 0, 1), (6, 0, 1, 0, 2), (7, 0, 2, 0, 1)], "doc_id, seq, numbers, distributions, subjects"))
def merge_runts(spark, d):
    n = lambda k: F.coalesce(F.try_element_at("anchors", F.lit(k)), F.lit(0))
    return _split(spark).where("doc_id not in (2, 3)").select("doc_id", "seq", n("letter_number").alias("numbers"), n("distribution").alias("distributions"), n("subject").alias("subjects"))


@query(_values([(1, 0, "letter"), (1, 1, "letter"), (2, 0, "order"), (3, 0, "fragment"), (5, 0, "letter"), (5, 1, "letter"), (6, 0, "letter"), (7, 0, "letter")], "doc_id, seq, form"))
def form_detect(spark, d):
    return _split(spark).select("doc_id", "seq", segment.form(F.col("text"), F.col("anchors")).alias("form"))


@query(_values([("order", 4500, "date,distribution,header"), ("letter", 8500, "closing"), ("fragment", 1500, "addressee,closing,date,letter_number,subject"), ("endorsement", 10000, "")], "form, score, missing"))
def completeness(spark, d):
    rows = [
        ("order", {"letter_number": 1, "date": 0}, "x" * 300), ("letter", {"letter_number": 1, "date": 1, "addressee": 1, "subject": 2}, "x" * 400), ("fragment", {}, "x" * 300),
        ("endorsement", {"letter_number": 1, "date": 1, "distribution": 1}, "x" * 300),
    ]
    df = _rows(spark, rows, "form string, anchors map<string,int>, text string")
    score = segment.completeness(F.col("form"), F.col("anchors"), F.col("text"))
    return df.select("form", F.round(score * 10000).cast("int").alias("score"), F.array_join(segment.missing(F.col("form"), F.col("anchors")), ",").alias("missing"))


@query("SELECT id, round((0.45 * c + 0.35 * k + 0.2 * t) * 10000)::BIGINT AS trust FROM (VALUES (1, 1.0, 1.0, 1.0), (2, 0.9, 0.85, 0.85), (3, 0.5, 0.3, 0.6), (4, 0.0, 0.0, 0.4)) v(id, c, k, t)")
def trust_score(spark, d):
    rows = _rows(spark, [(1, 1.0, 1.0, "unicode"), (2, 0.9, 0.85, "docx"), (3, 0.5, 0.3, "pdf"), (4, 0.0, 0.0, "other")], "id int, c double, k double, tier string")
    return rows.select("id", F.round(segment.trust(F.col("c"), F.col("k"), F.col("tier")) * 10000).cast("long").alias("trust"))


@query(_values([("file-start", Long(6), 0.75), ("header-after-close", Long(1), 0.125), ("repeated-subject", Long(1), 0.125)], "opened_by, n, share"))
def anchor_audit(spark, d):
    return segment.audit(_split(spark))


# --- fonts and gold ----------------------------------------------------------
@query(_values([(a, b) for a, b in X.PAIRS], "legacy, text"))
def font_convert(spark, d):
    return _rows(spark, [(a,) for a, _ in X.PAIRS], "legacy string").select("legacy", fonts.convert("legacy", X.TOY)["text"].alias("text"))


@query(_values([(1, "कि"), (2, "र्का"), (3, "क्षि"), (4, "र्"), (5, "राम")], "id, text"))
def reorder_passes(spark, d):
    rows = [(1, "िक"), (2, "का"), (3, "िक्ष"), (4, ""), (5, "राम")]
    return _rows(spark, rows, "id int, raw string").select("id", fonts.reorder(F.col("raw")).alias("text"))


@query(_values([(0, "अब", "-"), (0, "dk", "krutidev010"), (0, "e", "-"), (1, "xfd", "devlys010")], "block, text, font_table"))
def run_coalesce(spark, d):
    df = _rows(spark, X.RUNS, "id int, blocks array<array<struct<text:string,font:string>>>").select(F.posexplode("blocks").alias("block", "runs"))
    runs = fonts.coalesce_runs(F.col("runs"), lambda f: fonts.font_table(f)["table"])
    return df.select("block", F.explode(runs).alias("r")).select("block", "r.text", F.coalesce("r.table", F.lit("-")).alias("font_table"))


@query(_values([(i, x) for i, _, x in X.LATIN], "id, runs"))
def misfonted_latin(spark, d):
    return _rows(spark, [r[:2] for r in X.LATIN], "id int, text string").select("id", F.array_join(fonts.misfonted_latin("text"), ",").alias("runs"))


@query(_values([(Long(len(X.PAIRS)), Long(len(X.PAIRS)), 1.0)], "n, exact, char_accuracy"))
def gold_accuracy(spark, d):
    return fonts.accuracy(_rows(spark, X.PAIRS, "legacy string, expected string"), X.TOY)


@query(_values([(Long(11), Long(10), "h", 0.909091)], "slots, covered, uncovered, fraction"))
def slot_coverage(spark, d):
    return fonts.slot_coverage(_rows(spark, X.PAIRS, "legacy string, expected string"), X.TOY).select("slots", "covered", F.array_join("uncovered", ",").alias("uncovered"), "fraction")


def _reviewed(spark):
    rows = _rows(spark, [r[:4] for r in X.REVIEWS], "id int, verdict string, blind boolean, suggestion string")
    return gold.collect_review(rows, F.col("suggestion"))


@query(_values([(i, o) for i, *_, o in X.REVIEWS], "id, outcome"))
def review_outcomes(spark, d):
    return _reviewed(spark).select("id", "outcome")


@query(_values([(0.333333, 0.666667, Long(1), False)], "sighted, blind_rate, rejected, alarm"))
def disagreement_rates(spark, d):
    return gold.disagreement_rates(_reviewed(spark))


@query(_values([("घर", "धर", Long(3), True), ("दो", "", Long(1), False)], "lhs, rhs, n, systematic"))
def align_diff(spark, d):
    return gold.align(_rows(spark, X.READ_TWICE, "id int, a string, b string"), "a", "b")


@query(_values([(1, "bb", 3), (2, "c", 1)], "pick, legacy, gain"))
def greedy_cover(spark, d):
    picks = gold.greedy_cover(_rows(spark, X.PICKS, "legacy string, used_keys array<string>"), 5)
    return _rows(spark, [(i, k, g) for i, (k, g) in enumerate(picks, 1)], "pick int, legacy string, gain int")


# --- fields ------------------------------------------------------------------
def _extracted(spark):
    rows = [(1, "\n".join(X.LETTER_1)), (2, "\n".join([*X.LETTER_2, *X.ENDORSEMENT])), (3, "साधारण वाक्य")]
    return _rows(spark, rows, "id int, text string").withColumn("fields", fields.extract(F.col("text")))


@query(_values([
    (1, "letter_number", "blank", None), (1, "branch", "found", "रा०"), (1, "date", "blank", None), (1, "subject", "found", "भूमि की मापी के संबंध में"), (1, "reference", "absent", None), (1, "addressee", "found", "अंचल अधिकारी / छपरा सदर"),
    (1, "signatory", "found", "जिला पदाधिकारी"), (1, "office", "found", "कार्यालय जिला पदाधिकारी, सारण"), (1, "copy_to", "absent", None),
    (2, "letter_number", "found", "45/स्था०"), (2, "branch", "found", "स्था०"), (2, "date", "found", "2021-03-05"), (2, "subject", "found", "वेतन भुगतान के संबंध में"), (2, "reference", "absent", None), (2, "addressee", "found", "सभी प्रखंड कर्मी"),
    (2, "signatory", "found", "स्थापना उप समाहर्त्ता / ज्ञापांक 46/स्था०, दिनांक 05.03.2021"), (2, "office", "found", "कार्यालय जिला पदाधिकारी, सारण"), (2, "copy_to", "found", "कोषागार पदाधिकारी को सूचनार्थ प्रेषित"),
    *((3, n, "absent", None) for n in fields.NAMES),
], "id, field, state, value"))
def field_states(spark, d):
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"fields.{n}.state").alias("state"), F.col(f"fields.{n}.value").alias("value")) for n in fields.NAMES))
    return _extracted(spark).select("id", F.explode(pairs).alias("x")).select("id", "x.*")


@query(_values([(n, Long(f), Long(b), Long(3 - f - b), u) for n, f, b, u in [
    ("letter_number", 1, 1, 0.666667), ("branch", 2, 0, 0.666667), ("date", 1, 1, 0.666667), ("subject", 2, 0, 0.666667), ("reference", 0, 0, 0.0), ("addressee", 2, 0, 0.666667), ("signatory", 2, 0, 0.666667), ("office", 2, 0, 0.666667), ("copy_to", 1, 0, 0.333333),
]], "field, found, blank, absent, usable"))
def field_tally(spark, d):
    return fields.tally(_extracted(spark))


@query(_values([
    (1, "राजस्व", "branch", "भूमि", "subject"), (2, "स्थापना", "branch", "भुगतान", "subject"), (3, "शिक्षा", "office", "सामान्य पत्राचार", "default"), (4, "UNLABELLED", "none", "बैठक सूचना", "body"), (5, "UNLABELLED", "none", "UNLABELLED", "none"), (6, "विकास", "branch", "परिवाद", "subject"),
], "id, department, department_source, letter_type, letter_type_source"))
def bootstrap_labels(spark, d):
    rows = [
        (1, "रा०", None, None, "भूमि की मापी", ""), (2, "स्था०", "शिक्षा विभाग", None, "वेतन भुगतान", ""), (3, "अज्ञात", "शिक्षा विभाग", None, "कुछ और", "बैठक"), (4, None, None, "कोई", None, "कल बैठक है"), (5, None, None, None, "", "साधारण"), (6, "वि०", None, None, "परिवाद संख्या", ""),
    ]
    df = _rows(spark, rows, "id int, branch string, office string, signatory string, subject string, text string")
    return df.select("id", classify.bootstrap(*map(F.col, ("branch", "office", "signatory", "subject", "text"))).alias("b")).select("id", "b.*")


# --- sources, drafts, streaming ----------------------------------------------
@query(_values([(r[0], r[5]) for r in X.PDFS], "id, route"))
def ocr_routing(spark, d):
    df = _rows(spark, [r[:5] for r in X.PDFS], "id int, chars int, pages int, quality double, forced boolean")
    return df.select("id", archive.pdf_route(F.col("chars"), F.col("pages"), F.col("quality"), F.col("forced")).alias("route"))


@query("SELECT id, CASE WHEN tier <> 'ocr' THEN 1.0 ELSE greatest(0.0, least(1.0, (conf - 60) / 40)) END::DOUBLE AS confidence FROM (VALUES (1, 100.0, 'ocr'), (2, 60.0, 'ocr'), (3, 80.0, 'ocr'), (4, 10.0, 'ocr'), (5, 10.0, 'docx')) v(id, conf, tier)")
def ocr_confidence(spark, d):
    return _rows(spark, X.READINGS, "id int, conf double, tier string").select("id", archive.ocr_confidence(F.col("conf"), F.col("tier")).alias("confidence"))


@query("SELECT count(*) AS generated, count(*) FILTER (n > 1) AS dispatched, count(*) FILTER (n = 1) AS abandoned FROM (SELECT count(*) n FROM conversations WHERE role = 'assistant' GROUP BY conv_id)")
def draft_stats(spark, d):
    return store.draft_stats(_exchanges(spark, d).withColumnRenamed("text", "dispatched_text"))


@query(_values([(r[0], r[6]) for r in X.DRAFTS], "id, review"))
def needs_review(spark, d):
    df = _rows(spark, [r[:6] for r in X.DRAFTS], "id int, invented array<string>, truncated boolean, verdict string, sources int, letters int")
    return df.select("id", draft.needs_review(*map(F.col, ("invented", "truncated", "verdict", "sources", "letters"))).alias("review"))


@query()
def prompt_budget(spark, d):
    """Each benchmark text as a request, with its three best documents as exemplars."""
    docs = _letters(spark, d)
    hits = templates.measured(retrieve.top(_bm25(spark, d, _requests(spark, d), 3), 3)).join(docs.select("doc", "text"), "doc")
    ex = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", draft.exemplar_body("text").alias("t")))).alias("x"))
    rows = _requests(spark, d).join(ex, "query", "left").withColumn("p", draft.build_prompt("text", F.lit(None).cast("string"), F.transform("x", lambda r: r["t"])))
    return rows.select("query", "p.tokens", "p.dropped")


_LETTER_SQL = "'" + "' || chr(10) || '".join([X.HEAD, "पत्रांक--------------------/रा०, दिनांक 01.01.2024", "विषय:- विषय ' || item_id || '।", "महाशय,", "", "निवेदन है कि कार्य पूरा किया जाय।", "", "विश्वासभाजन", "जिला पदाधिकारी"]) + "'"


@query(f"""WITH {_BM25_WITH}, {_bm25_sql(_ASKED)}, k AS (SELECT query, least(count(*), 3) n FROM bm GROUP BY 1)
SELECT item_id AS id, {_LETTER_SQL} AS letter, coalesce(n, 0)::INTEGER AS sources, coalesce(n, 0) = 0 AS needs_review FROM benchmark LEFT JOIN k ON query = item_id""")
def draft_letters(spark, d):
    """Drafts for each benchmark text from its three best documents, with a stub in the model's place."""
    requests = _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("request"), F.concat(F.lit("विषय "), F.col("item_id").cast("string")).alias("subject"), F.lit("क/ख").alias("cell"), F.lit(None).cast("string").alias("number"), F.lit("01.01.2024").alias("on"))
    skeleton = _rows(spark, [("क/ख", X.LETTER_1[:2], [X.LETTER_1[6]], X.LETTER_1[8:]), ("", [], [], [])], "cell string, before array<string>, salutation array<string>, after array<string>")
    docs = _letters(spark, d)
    hits = templates.measured(retrieve.top(_bm25(spark, d, _requests(spark, d), 3), 3)).join(docs.select("doc", "text"), "doc").select(F.col("query").alias("id"), "rank", "text")
    out = draft.draft(requests, hits, skeleton, lambda prompts: ["निवेदन है कि कार्य पूरा किया जाय।"] * len(prompts), 100)
    return out.select("id", "letter", F.size("exemplars").alias("sources"), "needs_review")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    """No counterpart among the reference's operators."""
    return ingest.event_windows(_t(spark, d, "events"))
