"""Line dedup by content-defined chunks of lines, in built-in functions only.

A text's lines are hashed and a rolling hash is taken over each pair of neighbouring line
hashes. A cut lies between two lines where their rolling hash is less than that of the
pairs on either side: it depends on four lines only, so the cuts inside a shared passage
are the same wherever it stands, and no chunk between two cuts has fewer than two lines.
A chunk of two or more non-blank lines that occurs elsewhere too, in the same text or in
another, is removed everywhere but at its first place (least doc_id, then position).

Chunks alone miss short passages: a cut takes four lines, so what two texts share must hold
two cuts. With ``passages`` (op8 and the pipeline) every run of whole lines of over
``PASSAGE`` words that stands elsewhere too goes as well, down to a single line, and so does
a whole text of two or more non-blank lines. A shared run is the union of the shortest runs
of over PASSAGE words that begin or end at its lines, so these are what is looked up. A line
that goes has an equal one in an earlier place, hence one that stays.

Chunks and runs meet by hash; the bytes of the lines of those that share one are compared,
and where they differ a digest takes part in the key.

Cases: a null text stays null and has no lines; an empty text has one empty line; a text
of one line is a chunk of one line and stays (unless over PASSAGE words, with ``passages``);
very long texts are cut whole; of equal places in one document the first stays; rows that
repeat a doc_id are each judged by (doc_id, text), and rows equal in both are one document,
so all of them keep and lose the same lines; an empty table gives no rows; all further
columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Non-blank lines that a chunk needs to be removable.
MIN_LINES = 2
#: Words that a passage has more of.
PASSAGE = 50
#: What chunks and passages meet by.
HASH = "xxhash64(c.t)"
#: What lines are compared by before their bytes are.
LINE_HASH = "xxhash64(y)"
#: A range of lines is one number, first * RANGE + last.
RANGE = 1 << 31


def _let(name: str, value: str, then: str) -> str:
    """``then`` with ``name`` bound to ``value``, which is computed once for a row: a lambda over an array of one."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _numbers(n: str) -> str:
    """1 to n, or none."""
    return f"if({n} < 1, cast(array() as array<int>), sequence(1, {n}))"


def _loose(key: str) -> Column:
    """The key as the planner does not know it, so that it deals what was summed by it anew and AQE can split a hot key of the join."""
    return F.col(key).bitwiseXOR(F.lit(0)).alias(key)


def units_sql(text: str = "text", passages: bool = False) -> str:
    """What the text can lose: t (lines joined by \\n), a and b (first and last line, from 1), chunk (whether it is a chunk).

    With ``passages`` there are, besides chunks, the shortest run of over PASSAGE words that
    begins at each line with words and the shortest that ends there, and the whole text.
    """
    # r[i] is the rolling hash of lines i and i + 1; s holds the 1-based numbers of the lines that begin a chunk
    least = "(i = 0 or r[i] < r[i - 1]) and (i = size(r) - 1 or r[i] < r[i + 1])"
    begin = f"concat(array(1), if(size(r) = 0, cast(array() as array<int>), transform(filter(sequence(0, size(r) - 1), i -> {least}), i -> i + 2)))"
    roll = "if(size(h) < 2, cast(array() as array<bigint>), transform(sequence(0, size(h) - 2), i -> xxhash64(h[i], h[i + 1])))"
    several = f"size(filter(slice(l, int(x div {RANGE}L), int(x % {RANGE}L - x div {RANGE}L) + 1), y -> trim(y) <> '')) >= {MIN_LINES}"
    ends = f"transform(s, (b, k) -> b * {RANGE}L + coalesce(try_element_at(s, k + 2), size(l) + 1) - 1)"
    chunks = _let("h", "transform(l, x -> xxhash64(x))", _let("r", roll, _let("s", begin, f"filter({ends}, x -> {several})")))
    every = "d"
    if passages:
        # v holds the lines with words and how many; of such lines PASSAGE + 1 are over PASSAGE words
        words = "filter(transform(l, (x, i) -> struct(i + 1 as i, size(array_remove(split(x, '[\\\\x09-\\\\x0D\\\\x20]+'), '')) as w)), x -> x.w > 0)"
        step = f"(z, x) -> if(z.w > {PASSAGE}, z, struct(z.w + x.w as w, x.i as i))"
        ahead = f"transform(v, (x, k) -> struct(x.i as a, aggregate(slice(v, k + 1, {PASSAGE + 1}), struct(0 as w, 0 as i), {step}) as z))"
        back = f"transform(v, (x, k) -> struct(x.i as b, aggregate(reverse(slice(v, greatest(k + 1 - {PASSAGE}, 1), least(k + 1, {PASSAGE + 1}))), struct(0 as w, 0 as i), {step}) as z))"
        whole = f"filter(array({RANGE}L + size(l)), x -> {several})"
        runs = f"concat(transform(filter({ahead}, x -> x.z.w > {PASSAGE}), x -> x.a * {RANGE}L + x.z.i), transform(filter({back}, x -> x.z.w > {PASSAGE}), x -> x.z.i * {RANGE}L + x.b), {whole})"
        every = f"array_union(d, {_let('v', words, runs)})"
    piece = _let("a", f"int(x div {RANGE}L)", _let("b", f"int(x % {RANGE}L)", "struct(array_join(slice(l, a, b - a + 1), '\\n') as t, a, b, k < size(d) as chunk)"))
    return _let("l", f"split({text}, '\\n', -1)", _let("d", chunks, f"transform({every}, (x, k) -> {piece})"))


def _unlike(some: DataFrame) -> bool:
    """Whether units that meet by hash differ in their bytes. some: (text, units), units with first and last line and h.

    Each line is compared once for a text, with all lines of its hash, and each unit's
    sequence of line hashes with those of the units of its hash: if both agree everywhere,
    units of one hash have the same bytes.
    """
    lines = f"transform(array_distinct(flatten(transform(units, x -> slice(l, x.a, x.b - x.a + 1)))), y -> struct(0 as kind, {LINE_HASH} as h, y as v))"
    series = f"transform(units, x -> struct(1 as kind, x.h as h, array_join(transform(slice(l, x.a, x.b - x.a + 1), y -> hex({LINE_HASH})), ' ') as v))"
    seen = some.select(F.explode(F.expr(_let("l", "split(text, '\\n', -1)", f"concat({lines}, {series})"))).alias("x")).select("x.*")
    return not seen.groupBy("kind", "h").agg(F.min("v").alias("x"), F.max("v").alias("y")).where("x <> y").isEmpty()


def repeats(documents: DataFrame, passages: bool = False) -> DataFrame:
    """(doc_id, th, drop, chunks): for each text that loses lines, the ranges (a, b) lost, in order and apart, and how many chunks."""
    docs = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    unit = docs.select("doc_id", "th", F.explode(F.expr(units_sql(passages=passages))).alias("c"))
    # a unit is one number: first line, last line, whether it is a chunk
    narrow = unit.select("doc_id", "th", F.expr(f"(c.a * {RANGE}L + c.b) * if(c.chunk, -1, 1)").alias("u"), F.expr(HASH).alias("h"))
    # counts by hash are summed before they are shuffled; a join that AQE can split then finds the units with a partner
    often = unit.select(F.expr(HASH).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(_loose("h"))
    met = cut(narrow.join(often, "h", "left_semi").selectExpr("doc_id", "th", f"int(abs(u) div {RANGE}L) a", f"int(abs(u) % {RANGE}L) b", "u < 0 chunk", "h"))
    # only texts that hold such units are read again, for their bytes
    some = docs.join(met.groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b", "chunk", "h")).alias("units")), ["doc_id", "th"])
    keyed = met.withColumn("g", F.lit(""))
    if _unlike(some.select("text", "units")):  # a hash of several texts: a digest tells them apart
        keyed = some.withColumn("l", F.split("text", "\n", -1)).select("doc_id", "th", "l", F.explode("units").alias("x"))
        keyed = keyed.selectExpr("doc_id", "th", "x.*", "sha2(array_join(slice(l, x.a, x.b - x.a + 1), '\\n'), 256) g")
    first = keyed.groupBy("h", "g").agg(F.min("doc_id").alias("first")).select(_loose("h"), "g", "first")
    marked = keyed.join(first, ["h", "g"])
    # of the first document's own places the least stays: a document's places are bounded by its lines
    per = marked.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("h", "g", "a", "b", "chunk", (F.col("first") < F.col("doc_id")).alias("later")))).alias("m"))
    gone = F.expr("filter(m, (x, i) -> x.later or (i > 0 and m[i - 1].h = x.h and m[i - 1].g = x.g))")
    lost = per.select("doc_id", "th", gone.alias("gone")).where("size(gone) > 0")
    join = "if(size(z) > 0 and x.a <= element_at(z, -1).b + 1, concat(slice(z, 1, size(z) - 1), array(struct(element_at(z, -1).a as a, greatest(element_at(z, -1).b, x.b) as b))), concat(z, array(x)))"
    ranges = f"aggregate(array_sort(transform(gone, x -> struct(x.a as a, x.b as b))), cast(array() as array<struct<a: int, b: int>>), (z, x) -> {join})"
    return lost.select("doc_id", "th", F.expr(ranges).alias("drop"), F.expr("size(filter(gone, x -> x.chunk))").alias("chunks"))


def line_dedup(documents: DataFrame, passages: bool = False) -> DataFrame:
    """The documents with repeated chunks (and passages) removed, plus n_lines, n_removed (lines) and n_chunks_removed.

    All columns are kept; n_chars, if there is one, becomes the length of what is left.
    """
    gone = repeats(documents, passages).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    keyed = documents.withColumn("_t", F.xxhash64("text"))
    both = keyed.join(gone, (F.col("doc_id") == F.col("_id")) & (F.col("_t") == F.col("_th")), "left")
    left = _let("q", "filter(l, (x, i) -> not exists(drop, y -> i + 1 between y.a and y.b))", "struct(array_join(q, '\\n') as t, size(q) as kept)")
    out = both.withColumn("_n", F.expr("if(text is null, 0, size(split(text, '\\n', -1)))")).withColumn("_x", F.expr(f"if(text is null or drop is null, null, {_let('l', "split(text, '\\n', -1)", left)})"))
    new = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.col("_x.t"))
    cols = [new.alias("text") if c == "text" else F.length(new).cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in documents.columns]
    n = F.col("_n").cast("long")
    return out.select(*cols, n.alias("n_lines"), (n - F.coalesce(F.col("_x.kept").cast("long"), n)).alias("n_removed"), F.coalesce("chunks", F.lit(0)).cast("long").alias("n_chunks_removed"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, passages=True).select("doc_id", "text", "n_lines", "n_removed", "n_chunks_removed")
