"""Legacy-font conversion: longest-match substitution and reordering, as Column expressions over a table of pairs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


class FontTable:
    """A legacy-to-Unicode map; a slot Z in a value stands for the reph mark."""

    def __init__(self, name: str, pairs: dict[str, str]):
        self.name, self.pairs = name, pairs

    def without_digits(self) -> FontTable:
        return FontTable(self.name, {k: v for k, v in self.pairs.items() if not (len(k) == 1 and (k.isdigit() or v in R.DEVA_DIGITS))})


def read_table(spark: SparkSession, folder: str, name: str, within: tuple[str, ...] = ()) -> FontTable:
    """A table of ``folder``/name.tsv: legacy TAB unicode TAB comment; ``#inherit parent`` first takes the parent's rows."""
    if name in within:
        raise ValueError(f"tables inherit in a circle: {' > '.join((*within, name))}")
    pairs: dict[str, str] = {}
    for n, row in enumerate(spark.read.text(f"{folder}/{name}.tsv", wholetext=True).first().value.splitlines(), 1):
        if row.startswith("#inherit"):
            pairs = {**read_table(spark, folder, row.split(None, 1)[1].strip(), (*within, name)).pairs, **pairs}
        elif row.strip() and not (row.startswith("#") and not row.startswith("#\t")):
            legacy, _, rest = row.partition("\t")
            value = rest.split("\t")[0]
            if not legacy or not value:
                raise ValueError(f"{name}.tsv, line {n}: a key or value is empty")
            pairs[legacy] = value.replace("Z", R.REPH_MARK)
    return FontTable(name, pairs)


def _pieces(col: Column, table: FontTable) -> Column:
    """A text cut into the table's keys, longest first, and single characters."""
    keys = sorted(table.pairs, key=lambda k: (-len(k), k))
    return F.regexp_extract_all(col, F.lit("(?s)(" + "|".join([*map(re.escape, keys), "."]) + ")"), F.lit(1))


def _map(table: FontTable) -> Column:
    return F.create_map(*(F.lit(x) for p in table.pairs.items() for x in p))


def reorder(col: Column) -> Column:
    """The pre-base vowel goes behind its cluster, and the reph mark before it."""
    cluster = rf"[{R.CONSONANTS}]{R.NUKTA}?(?:{R.VIRAMA}[{R.CONSONANTS}]{R.NUKTA}?)*"
    c = F.regexp_replace(col, f"{R.I_MATRA}({cluster})", f"$1{R.I_MATRA}")
    c = F.regexp_replace(c, f"({cluster})([{R.MATRAS}{R.SIGNS}]*){R.REPH_MARK}", f"{R.REPH}$1$2")
    return F.replace(c, F.lit(R.REPH_MARK), F.lit(R.REPH))


def convert(col: Column | str, table: FontTable, normalise: bool = True) -> Column:
    """struct(text, unmapped, used_keys): unmapped counts characters without an entry that are no white space."""
    c = F.col(col) if isinstance(col, str) else col
    m = _map(table)

    def done(parts: Column) -> Column:
        text = reorder(F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(m, p), p)), ""))
        lost = F.filter(parts, lambda p: F.try_element_at(m, p).isNull() & ~p.rlike(r"(?U)^\s$"))
        counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(lost)), lambda x: F.struct(x.alias("key"), F.size(F.filter(lost, lambda y: y == x)).alias("value"))))
        used = F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.try_element_at(m, p).isNotNull())))
        return F.struct(text.alias("text"), counts.alias("unmapped"), used.alias("used_keys"))

    out = T.let(_pieces(c, table), done)
    return F.struct(T.normalise(out["text"], True).alias("text"), out["unmapped"].alias("unmapped"), out["used_keys"].alias("used_keys")) if normalise else out


#: Fonts by name, and by what their names contain.
REGISTRY = {"kruti dev 010": "krutidev010", "krutidev010": "krutidev010", "kruti dev 041": "krutidev041", "devlys 010": "devlys010", "devlys 040": "devlys040"}
STEMS = [("kruti", "krutidev010"), ("devlys", "devlys010")]


def font_table(font: Column) -> Column:
    """struct(table, how): a font's table by its name, by a part of it, or none."""
    name = F.lower(F.trim(T.collapse(font)))
    exact = F.try_element_at(F.create_map(*(F.lit(x) for p in REGISTRY.items() for x in p)), name)
    stem = F.coalesce(*(F.when(F.contains(name, F.lit(s)), F.lit(t)) for s, t in STEMS))
    return F.struct(F.coalesce(exact, stem).alias("table"), F.when(font.isNull(), "unknown").when(exact.isNotNull(), "exact").when(stem.isNotNull(), "guessed").otherwise("unknown").alias("how"))


def coalesce_runs(runs: Column, table_of) -> Column:
    """Runs (text, font) with neighbours of one table joined; the first's font stays."""
    empty = F.array().cast("array<struct<text:string,font:string,table:string>>")

    def step(acc: Column, r: Column) -> Column:
        t = table_of(r["font"])
        last = F.try_element_at(acc, F.lit(-1))
        one = F.struct(r["text"].alias("text"), r["font"].alias("font"), t.alias("table"))
        both = F.struct(F.concat(last["text"], r["text"]).alias("text"), last["font"].alias("font"), last["table"].alias("table"))
        return F.when((F.size(acc) > 0) & last["table"].eqNullSafe(t), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(runs, empty, step)


def misfonted_latin(col: Column | str) -> Column:
    """Runs of capitals, digits and ./- that were typed as Latin in a legacy font: three long, two capitals, a digit or separator."""
    c = F.col(col) if isinstance(col, str) else col
    found = F.regexp_extract_all(c, F.lit("[A-Z0-9./\\-]{3,}"), F.lit(0))
    return F.filter(found, lambda x: (F.regexp_count(x, F.lit("[A-Z]")) >= 2) & x.rlike("[0-9./\\-]"))


def convert_document(docs: DataFrame, tables: dict[str, FontTable], runs: str = "blocks", force: str | None = None) -> DataFrame:
    """docs (path, blocks: array of arrays of (text, font)) with text: runs converted by their font's table, blocks joined by \\n.

    Runs without a table pass through, and so do misfonted Latin runs within a converted one.
    """
    turn = lambda t: lambda p: F.when(F.size(misfonted_latin(p)) > 0, p).otherwise(convert(p, t, False)["text"])

    def one(r: Column) -> Column:
        out = r["text"]
        for name, t in tables.items():
            latin = "[A-Z0-9./\\-]{3,}"
            pieces = F.regexp_extract_all(r["text"], F.lit(f"(?s)({latin}|(?:(?!{latin}).)+)"), F.lit(1))
            turned = F.array_join(F.transform(pieces, turn(t)), "")
            out = F.when(F.lit(force == name) if force else r["table"] == name, turned).otherwise(out)
        return out

    block = lambda b: F.array_join(F.transform(coalesce_runs(b, lambda f: font_table(f)["table"]), one), "")
    return docs.withColumn("text", T.normalise(F.array_join(F.transform(runs, block), "\n"), True))


def table_usage(docs: DataFrame, runs: str = "blocks", force: str | None = None, rescue: bool = True) -> DataFrame:
    """(table, chars): the characters that each table converts, those that pass through and the Latin ones that are kept as they are."""
    of = (lambda f: F.lit(force)) if force else (lambda f: font_table(f)["table"])
    r = docs.select(F.explode(runs).alias("b")).select(F.explode(coalesce_runs(F.col("b"), of)).alias("r")).select("r.text", "r.table")
    latin = F.aggregate(misfonted_latin("text"), F.lit(0), lambda a, x: a + F.length(x)) if rescue else F.lit(0)
    own = F.when(F.col("table").isNull(), F.array(F.struct(F.lit("(passthrough)").alias("table"), F.length("text").alias("n"))))
    own = own.otherwise(F.array(F.struct(F.col("table").alias("table"), (F.length("text") - latin).alias("n")), F.struct(F.lit("(rescued-latin)").alias("table"), latin.alias("n"))))
    return r.select(F.explode(own).alias("x")).where("x.n > 0").groupBy("x.table").agg(F.sum("x.n").alias("chars"))


def list_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of a folder's tables, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tsv").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.tsv$", 1).alias("name")).orderBy("name")


def accuracy(pairs: DataFrame, table: FontTable) -> DataFrame:
    """n, exact, char_accuracy over gold pairs (legacy, expected)."""
    got = pairs.select(convert("legacy", table)["text"].alias("got"), T.normalise("expected", True).alias("want"))
    got = got.select((F.col("got") == F.col("want")).cast("int").alias("exact"), F.levenshtein("got", "want").alias("d"), F.length("want").alias("len"))
    return got.agg(F.count("*").alias("n"), F.sum("exact").alias("exact"), F.round(F.greatest(F.lit(0.0), 1 - F.sum("d") / F.sum("len")), 6).alias("char_accuracy"))


def slot_coverage(pairs: DataFrame, table: FontTable) -> DataFrame:
    """slots, covered, fraction, uncovered (sorted) of a table by gold pairs."""
    used = pairs.select(F.explode(convert("legacy", table)["used_keys"]).alias("k")).distinct()
    every = pairs.sparkSession.createDataFrame([(k,) for k in table.pairs], "k string")
    out = every.join(used.withColumn("hit", F.lit(1)), "k", "left")
    return out.agg(F.count("*").alias("slots"), F.count("hit").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("hit").isNull(), F.col("k")))).alias("uncovered")).withColumn("fraction", F.round(F.col("covered") / F.col("slots"), 6))
