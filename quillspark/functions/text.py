"""Scalar text functions as Column builders; all but NFC run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then) -> Column:
    """``then(value)``, with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(col: Column | str) -> Column:
    """Canonical composition, which no built-in offers."""
    return F.pandas_udf(_compose, "string")(_c(col))


#: Letters with a nukta are kept apart as consonant and nukta.
NUKTA_LETTERS = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in (*range(0x0958, 0x0960), 0x0929, 0x0931, 0x0934)}


def normalise(col: Column | str, converted: bool = False) -> Column:
    """NFC, decomposed nukta letters, no joiners, \\n line ends, single spaces, none around line ends.

    Texts of ASCII and Latin-1 letters alone are in NFC, so only others pay for the Arrow UDF.
    Of ``converted`` text, which is Devanagari and ASCII, NFC would only order marks: the
    nukta before the virama before accents, which two replacements do.
    """
    c = _c(col)
    if converted:
        c = F.regexp_replace(F.regexp_replace(c, "([\u0951-\u0954])([\u093c\u094d]+)", "$2$1"), "\u094d\u093c", "\u093c\u094d")
    else:
        c = F.when(c.rlike(r"^[\x00-\x7f\u00a0-\u00ff]*$"), c).otherwise(nfc(c))
    for one, two in NUKTA_LETTERS.items():
        c = F.replace(c, F.lit(one), F.lit(two))
    c = F.regexp_replace(c, "[\u200c\u200d]", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    return squeeze(c)


def squeeze(col: Column | str) -> Column:
    """Runs of blanks as one space, none around line ends or at either end."""
    c = F.regexp_replace(_c(col), "[ \\t\u00a0]+", " ")
    c = F.regexp_replace(c, " *\\n *", "\n")
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse(col: Column | str) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(_c(col), r"(?U)\s+", " ")


def script_ratio(col: Column | str) -> Column:
    """Devanagari letters among letters; 0 without letters."""
    c = _c(col)
    n = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(c, F.lit(r"[\p{L}&&[\u0900-\u097F]]")) / n)


def violations(col: Column | str) -> Column:
    """Map of rule to how often it is broken, for rules that are."""
    c = _c(col)
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.regexp_count(c, F.lit(R.FLAGS + p)).alias("value")) for n, _, p in R.VALIDATOR))
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"] > 0))


def weighted_violations(col: Column | str) -> Column:
    c = _c(col)
    total = F.lit(0.0)
    for _, w, p in R.VALIDATOR:
        total = total + F.lit(w) * F.regexp_count(c, F.lit(R.FLAGS + p))
    return total


def quality(col: Column | str, hit_rate: Column | None = None, devanagari: bool = True) -> Column:
    """Score 0..1 from rule violations per word, the script's share and, if given, the share of words in a vocabulary."""
    c = _c(col)
    words = F.regexp_count(c, F.lit("[\\u0900-\\u097F\\ua8e0-\\ua8ff]+"))
    seq = F.greatest(F.lit(0.0), 1 - weighted_violations(c) / F.greatest(words, F.lit(1)))
    ratio = script_ratio(c)
    mixed = 0.65 * seq + 0.35 * ratio
    if hit_rate is not None:
        mixed = F.when(hit_rate.isNull(), mixed).otherwise(0.50 * seq + 0.30 * ratio + 0.20 * hit_rate)
    score = F.when(words == 0, ratio).otherwise(mixed) if devanagari else seq
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def bucket(col: Column | str, cuts: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """The label of the first cut that a value reaches (or exceeds)."""
    c, out = _c(col), None
    for at, label in cuts:
        test = c > at if strict else c >= at
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


#: The cut-offs of segment, quality and effort verdicts.
SEGMENT_CUTS = ([(0.80, "index"), (0.60, "review")], "quarantine", False)
QUALITY_CUTS = ([(0.85, "clean"), (0.60, "review")], "quarantine", False)
EFFORT_CUTS = ([(0.70, "failed"), (0.30, "heavy"), (0.10, "edited")], "as-drafted", True)


def visarga_to_colon(col: Column | str) -> tuple[Column, Column]:
    """(text, count): a visarga typed for a colon after labels, at the end of words that don't end in one, and on its own."""
    c = _c(col)
    label = "(" + "|".join(R.COLON_LABELS) + ")" + R.VISARGA
    one = F.regexp_replace(c, label, "$1:")
    n = F.regexp_count(c, F.lit(label))
    # of a run of Devanagari the last visarga ends the word; the whole word decides
    kept = "|".join(w[:-1] for w in R.VISARGA_WORDS if w.endswith(R.VISARGA))
    final = rf"(?U)(?<![\u0900-\u097F])(?!(?:{kept}){R.VISARGA}(?:\s|\z))([\u0900-\u097F]+){R.VISARGA}(?=\s|\z)"
    two = F.regexp_replace(one, final, "$1:")
    alone = rf"(?U)(?<=\s){R.VISARGA}"
    return F.regexp_replace(two, alone, ":"), n + F.regexp_count(one, F.lit(final)) + F.regexp_count(two, F.lit(alone))


def tidy_punctuation(col: Column | str) -> Column:
    c = F.regexp_replace(_c(col), r"(?U)\s+([,;:।॥)\]])", "$1")
    return F.regexp_replace(c, r"([,;:।])(?=[\u0900-\u097FA-Za-z])", "$1 ")


def repair(col: Column | str) -> Column:
    """struct(text, visarga_to_colon, punctuation_tidied): both repairs, how many visargas, and whether punctuation changed."""
    text, n = visarga_to_colon(col)
    one = lambda x: F.struct(tidy_punctuation(x).alias("text"), n.alias("visarga_to_colon"), (tidy_punctuation(x) != x).cast("int").alias("punctuation_tidied"))
    return let(text, one)


#: Word classes, each its own: index tokens, query words, vocabulary words, alignment words.
INDEX_TOKEN = r"[\p{L}\p{N}\p{Mn}\p{Mc}\p{Co}]+"
QUERY_WORD = "[ऀ-ॣ०-९ॲ-ॿA-Za-z0-9]+"
VOCABULARY_WORD = "[ऀ-ॿ꣠-ꣿ]+"
ALIGNMENT_WORD = "[ऀ-ॿ]+"


def tokens(col: Column | str, pattern: str = INDEX_TOKEN) -> Column:
    """All matches of a word class, lower-case."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(pattern), F.lit(0))


def query_terms(col: Column | str, most: int = 24) -> Column:
    """The first ``most`` words of more than one character, repeats kept."""
    return F.slice(F.filter(F.regexp_extract_all(_c(col), F.lit(QUERY_WORD), F.lit(0)), lambda w: F.length(w) > 1), 1, most)


def char_ngrams(col: Column | str, lo: int, hi: int) -> Column:
    """All n-grams of a text, shorter ones first; none where it is too short."""
    c = _c(col)
    at = lambda n: lambda i: F.substring(c, i, F.lit(n))
    none = F.array().cast("array<string>")
    parts = [F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), at(n))).otherwise(none) for n in range(lo, hi + 1)]
    return F.concat(*parts)


def fnv1a(col: Column | str, buckets: int) -> Column:
    """32-bit FNV-1a over code points, modulo ``buckets``."""
    codes = F.transform(F.filter(F.split(_c(col), ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, x: ((a.bitwiseXOR(x)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return (h % buckets).cast("int")


def digits(col: Column | str) -> Column:
    return F.translate(_c(col), R.DEVA_DIGITS, R.ASCII_DIGITS)


#: What (?U)\s matches; without a regular expression it is stripped faster.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_MARKS = r"[\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963]"


def canonical_line(col: Column | str) -> Column:
    """A line without what varies between copies: fill-in runs, numbers, spaces, the order of marks, outer punctuation."""
    c = F.regexp_replace(_c(col), R.BLANK_RUN, "░")
    c = F.regexp_replace(c, "[0-9०-९]+", "#")
    c = F.translate(c, WHITE, "")

    def sort_marks(x: Column) -> Column:
        # pieces are runs of two or more marks, which are sorted, or single characters
        pieces = F.regexp_extract_all(x, F.lit(rf"(?s)({_MARKS}{{2,}}|.)"), F.lit(1))
        order = F.transform(pieces, lambda p: F.when(F.length(p) > 1, F.array_join(F.array_sort(F.filter(F.split(p, ""), lambda y: y != "")), "")).otherwise(p))
        return F.when(x.rlike(_MARKS + "{2}"), F.array_join(order, "")).otherwise(x)

    return F.btrim(let(c, sort_marks), F.lit(" ,।;:."))


def iso_date(col: Column | str) -> Column:
    """Day-first dates as yyyy-mm-dd: numbers, or a month's name; two-digit years below 50 are 20xx. No calendar check."""
    c = digits(col)
    num = r"([0-9]{1,2})\s*[-/.–]\s*([0-9]{1,2})\s*[-/.–]\s*([0-9]{2,4})"
    named = r"([0-9]{1,2})\s+(" + "|".join(R.MONTH_NUMBERS) + r")\s+([0-9]{2,4})"
    months = F.create_map(*(F.lit(x) for p in R.MONTH_NUMBERS.items() for x in p))
    is_num = c.rlike(num)
    part = lambda i: F.when(is_num, F.regexp_extract(c, num, i)).otherwise(F.regexp_extract(c, named, i))
    d, y = part(1).try_cast("int"), part(3).try_cast("int")
    m = F.when(is_num, F.regexp_extract(c, num, 2).try_cast("int")).otherwise(F.try_element_at(months, F.regexp_extract(c, named, 2)))
    y = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    ok = d.between(1, 31) & m.between(1, 12) & y.between(1900, 2100)
    return F.when(ok, F.format_string("%04d-%02d-%02d", y, m, d))


def token_estimate(col: Column | str, fertility: float = 1.97) -> Column:
    """About how many model tokens a text takes."""
    c = _c(col)
    count = lambda p: F.regexp_count(c, F.lit(p))
    x = count("[ऀ-ॣ०-९ॲ-ॿ]+") * fertility + count("[A-Za-z]+") * 1.3 + count("[0-9]") / 2 + count(r"[^\p{L}\p{N}_\s\u00a0]") * 0.5
    return x.cast("int") + 8


def unsupported_numbers(body: Column | str, source: Column | str) -> Column:
    """Numbers of two or more digits in a body of which the source has neither form, sorted."""
    found = lambda x: F.regexp_extract_all(_c(x), F.lit("[0-9०-९]{2,}"), F.lit(0))
    known = F.transform(found(source), digits)
    return F.array_sort(F.array_distinct(F.filter(found(body), lambda t: ~F.array_contains(known, digits(t)))))


#: What is taken out of a generated body (label, pattern, replacement, whether hits are counted), in order.
CLEANING = [
    ("code fence", r"^\s*```.*$", "", True),
    ("markdown heading", r"^\s*#{1,6}\s+", "", True),
    ("markdown bullet", r"^\s*[*+\-]\s+", "", True),
    ("markdown bold", r"\*{1,3}(.+?)\*{1,3}", "$1", False),
    ("placeholder line the model invented", r"^\s*[\[<][^\]>\n]{1,40}[\]>][,।\s]*$", "", True),
    ("inline placeholder", r"[\[<][^\]>\n]{1,40}[\]>]", "", False),
    ("invented letter-number line", r"^.*(?:पत्रांक|ज्ञापांक|पत्र\s*संख्या|स्मारांक|फा\s*\.?\s*सं).*$", "", True),
    ("invented date line", r"^\s*दिनांक\s*[:ः\-–]?.*$", "", True),
    ("duplicate subject line", r"^\s*विषय\s*[:ः\-–].*$", "", True),
    ("salutation the skeleton supplies", r"^\s*(?:महोदय[ा]?|महाशय[ा]?|श्रीमान[्]?|प्रिय\s+\S+)[,।\s]*$", "", True),
    ("closing block the skeleton supplies", r"^\s*(?:विश्वासभाजन|भवदीय[ा]?|भवदीया|धन्यवाद|सधन्यवाद|आपका\s+विश्वासभाजन|हस्ताक्षर(?:ित)?|अनु\s*[०0].*|प्रतिलिपि.*)[,।;:.\s]*$", "", True),
    ("inline letter number", r"(?:पत्रांक|ज्ञापांक|पत्र\s*संख्या|स्मारांक)\s*[:ः\-–]?\s*[^\s,।]{1,30}", "", False),
]


def clean_body(col: Column | str) -> tuple[Column, Column]:
    """(text, labels): a generated body without what the skeleton supplies, and what was taken out."""
    c, labels = _c(col), []
    for label, pattern, new, counted in CLEANING:
        p = R.FLAGS + pattern
        n = F.regexp_count(c, F.lit(p))
        labels.append(F.when(n > 0, F.concat(F.lit(label + " ("), n.cast("string"), F.lit(")")) if counted else F.lit(label)))
        c = F.regexp_replace(c, p, new)
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", "")
    return c, F.array_compact(F.array(*labels))


def effort_text(col: Column | str, most: int = 20_000) -> Column:
    """The form in which drafts and dispatched texts are compared."""
    c = F.regexp_replace(_c(col), r"[ \t\u00a0]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r" +\n", "\n"), r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""), 1, most)


def effort(draft: Column | str, sent: Column | str) -> Column:
    """Edit distance over the sent text's length; 1 if that is empty."""
    a, b = effort_text(draft), effort_text(sent)
    return F.when(F.length(b) == 0, F.lit(1.0)).otherwise(F.levenshtein(a, b) / F.length(b))
