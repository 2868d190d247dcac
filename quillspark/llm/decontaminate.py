"""Benchmark decontamination by winnowing, in built-in functions only.

Both sides are cut into words, every run of ``GRAM`` words gets a hash, and of each window
of ``SPAN`` words the least of its ``GRAMS`` gram hashes is kept, at its first place. Equal
windows keep equal hashes, so joining them finds every shared span of SPAN words; a hit is
then extended to the windows around its place, whose words are compared. An item of fewer
than SPAN words is one window, fingerprinted by all its words.

Cases: null or wordless texts have no words and no hits; texts are taken whole, however
long, with two or three fingerprints for ten words; of equal least hashes the first counts,
on both sides; an empty table gives no rows (an empty benchmark: no hits); rows that repeat
a doc_id give a row each; further columns of either side are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Words in a window, and in a gram: 13 = 8 + 6 - 1.
SPAN, GRAM = 13, 8
#: Grams of a window.
GRAMS = SPAN - GRAM + 1
#: The benchmark's windows are broadcast up to this size; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: What separates words, once A-Z are lower-case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, in order; never null."""
    # a separator at either end leaves an empty string there
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def _hash(array: str, start: str, n: int) -> str:
    return "xxhash64(" + ", ".join(f"{array}[{start} + {j}]" for j in range(n)) + ")"


def _least(start: str) -> str:
    """The fingerprint of the window at ``start``, from the gram hashes h."""
    return "least(" + ", ".join(f"h[{start} + {j}]" for j in range(GRAMS)) + ")"


def _where(start: str, least: str) -> str:
    """The place of the window's fingerprint: the first gram that has the least hash."""
    return "case " + " ".join(f"when h[{start} + {j}] = {least} then {start} + {j}" for j in range(GRAMS)) + " end"


def _worded(df: DataFrame, *keep: str | Column) -> DataFrame:
    """keep, w (words) and n (how many)."""
    return df.select(*keep, words(F.col("text")).alias("w")).withColumn("n", F.size("w"))


def _hashed(df: DataFrame) -> DataFrame:
    """Adds wh, the words' hashes, and h, the hash of each gram."""
    return df.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn(
        "h", F.expr(f"if(n < {GRAM}, array(), transform(sequence(0, n - {GRAM}), i -> {_hash('wh', 'i', GRAM)}))")
    )


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, span, f, win): each window of each item, once: its length, fingerprint and words."""
    items = _hashed(_worded(benchmark, "item_id").where("n > 0"))
    starts = items.selectExpr("item_id", "w", "wh", "h", "n", f"least(n, {SPAN}) span", f"explode(sequence(0, greatest(n - {SPAN}, 0))) s")
    f = F.expr(f"if(span = {SPAN}, {_least('s')}, xxhash64(wh))")
    return starts.select("item_id", "span", f.alias("f"), F.array_join(F.slice("w", F.col("s") + 1, F.col("span")), " ").alias("win")).distinct()


def _picked(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, w, p, f): place and hash of each fingerprint of each document, and a row with p = -1 for the document itself.

    Neighbouring windows mostly have the same fingerprint, which is given once.
    """
    rows = _hashed(docs).selectExpr("doc_id", "th", "n", "w", "h", f"explode(sequence(-1, greatest(n - {SPAN}, -1))) s")
    rows = rows.withColumn("f", F.expr(f"if(s < 0, null, {_least('s')})")).withColumn("p", F.expr(f"if(s < 0, -1, {_where('s', 'f')})"))
    # the window before has this fingerprint too if its first gram's hash is greater and its other grams include the place
    same = f"s > 0 and p < s + {GRAMS - 1} and h[s - 1] > f"
    return rows.where(f"not ({same})").select("doc_id", "th", "n", "w", "p", "f")


def _short(docs: DataFrame, spans: list[int]) -> DataFrame:
    """(doc_id, th, n, w, span, p, f): hash and place of each run of so many words, for all of the lengths in one scan."""
    rows = docs.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x))).withColumn("span", F.explode(F.array(*map(F.lit, spans)))).where("n >= span")
    return rows.selectExpr("doc_id", "th", "n", "w", "wh", "span", "explode(sequence(0, n - span)) p").selectExpr("doc_id", "th", "n", "w", "span", "p", "xxhash64(slice(wh, p + 1, span)) f")


def hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, n, s, span, item_id): a row without s for each document, and one for each window that an item shares.

    th is a hash of the text. A document's fingerprint that the benchmark lacks gives no
    row, so what is shuffled are documents and hits. A shared fingerprint is extended to
    all windows that it can stand for. The items of fewer than SPAN words, if there are
    any, take one further scan together, whatever their lengths.
    """
    wins = cut(windows(benchmark))
    size = wins.select(F.sum(F.octet_length("win") + F.octet_length(F.col("item_id").cast("string")) + 64)).first()[0] or 0
    near = F.broadcast if size <= BROADCAST_BYTES else (lambda x: x)
    spans = [r.span for r in wins.where(F.col("span") < SPAN).select("span").distinct().orderBy("span").collect()]  # SPAN values at most
    base = _worded(documents, "doc_id", F.xxhash64("text").alias("th"))
    prints = near(wins.where(F.col("span") == SPAN).select("f").distinct().withColumn("in", F.lit(True)))
    met = _picked(base).join(prints, "f", "left").where("p < 0 or in").selectExpr("doc_id", "th", "n", "w", f"if(p < 0, 0, {SPAN}) span", "p")
    if spans:
        met = met.unionByName(_short(base, spans).join(near(wins.where(F.col("span") < SPAN).select("span", "f").distinct()), ["span", "f"], "left_semi").drop("f"))
    if size > BROADCAST_BYTES:  # places are looked up without words, which are joined to those found
        places = met.where("span > 0").groupBy("doc_id", "th").agg(F.collect_set(F.struct("span", "p")).alias("ps"))
        itself = F.array(F.struct(F.lit(0).alias("span"), F.lit(-1).alias("p")))
        met = base.join(places, ["doc_id", "th"], "left").withColumn("x", F.explode(F.concat(itself, F.coalesce("ps", F.slice(itself, 1, 0))))).select("doc_id", "th", "n", "w", "x.*")
    found = met.selectExpr("doc_id", "th", "n", "w", "span", f"explode(if(span = 0, array(null), if(span < {SPAN}, array(p), sequence(greatest(p - {GRAMS - 1}, 0), least(p, n - {SPAN}))))) s")
    found = found.selectExpr("doc_id", "th", "n", "s", "nullif(span, 0) span", "if(span = 0, null, array_join(slice(w, s + 1, span), ' ')) win")
    # the words themselves decide
    sure = found.join(near(wins.select("item_id", F.col("span").alias("k"), F.col("win").alias("v"))), (F.col("span") == F.col("k")) & (F.col("win") == F.col("v")), "left")
    return sure.where("s is null or item_id is not null").select("doc_id", "th", "n", "s", "span", "item_id")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, n_words, spans, items, rows): hit windows (start, length), the items they are from, and how many rows are alike."""
    return hits(documents, benchmark).groupBy("doc_id", "th").agg(
        F.max("n").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "span")))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        F.count_if(F.col("s").isNull()).alias("rows"),
    )


#: Words that lie in any of the windows.
N_HIT = """aggregate(spans, named_struct('sum', 0L, 'end', 0L),
    (a, x) -> named_struct('sum', a.sum + greatest(x.s + x.span - greatest(a.end, cast(x.s as bigint)), 0L), 'end', greatest(a.end, cast(x.s + x.span as bigint))),
    a -> a.sum)"""


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of documents: words, hit words, items, whether it counts as contaminated, and whether a whole window of SPAN words is in it (full)."""
    out = decontaminate(documents, benchmark).withColumn("n_hit", F.expr(N_HIT)).withColumn("_", F.expr("explode(sequence(1, rows))"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.expr(f"exists(spans, x -> x.span = {SPAN})").alias("full"), "th",
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("full", "th")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, text FROM documents),
dw AS (SELECT doc_id, row_number() OVER () rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM d),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
b AS (SELECT item_id, len(w) n, w FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(n, 13) span, array_to_string(w[s:s + least(n, 13) - 1], ' ') v FROM (SELECT *, unnest(range(1, greatest(n - 13, 0) + 2)) s FROM b)),
spans AS (SELECT DISTINCT span FROM win),
pos AS (SELECT rid, span, s, array_to_string(w[s:s + span - 1], ' ') v FROM (SELECT rid, w, span, unnest(range(1, len(w) - span + 2)) s FROM dw, spans WHERE len(w) >= span)),
hit AS (SELECT rid, p.span, s, item_id FROM pos p JOIN win USING (span, v)),
cov AS (SELECT rid, count(DISTINCT x) n_hit FROM (SELECT rid, unnest(range(s, s + span)) x FROM (SELECT DISTINCT rid, s, span FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) n_items, string_agg(i, ',' ORDER BY i) l FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) i FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
