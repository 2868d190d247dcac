"""Nine fields of a letter, each found, blank or absent, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.text import let

NAMES = ["letter_number", "branch", "date", "subject", "reference", "addressee", "signatory", "office", "copy_to"]
_KIND = "struct<state:string,value:string,raw:string>"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _strip(c: Column, chars: str) -> Column:
    cls = "[" + "".join("\\" + x if x in "-^]\\" else x for x in chars) + "]+"
    return F.regexp_replace(c, rf"\A{cls}|{cls}\z", "")


def clean(c: Column) -> Column:
    """White space collapsed, outer separators dropped."""
    return _strip(T.collapse(c), " \t:ः-–—।,")


def _raw(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"(?U)\A\s+|\s+\z", "")


def field(state: Column | str, value: Column | None = None, raw: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((F.lit(state) if isinstance(state, str) else state).alias("state"), (none if value is None else value).alias("value"), (none if raw is None else raw).alias("raw"))


def _after(text: Column, pattern: str) -> Column:
    """What follows the first match; null without one."""
    p = F.lit(R.FLAGS + pattern)
    at = F.regexp_instr(text, p)
    return F.when(at > 0, F.substring(text, at + F.length(F.regexp_substr(text, p)), F.length(text)))


def _until(chunk: Column, pattern: str, otherwise: Column, first: int = 1) -> Column:
    """The text up to a match that begins at ``first`` (from 1) or later."""
    at = F.regexp_instr(chunk, F.lit(R.FLAGS + pattern))
    return F.when(at >= first, F.substring(chunk, F.lit(1), at - 1)).otherwise(otherwise)


def labelled(text: Column, label: str, most: int = 300, one_line: bool = True) -> Column:
    """The value after a label: up to the line's or ``most`` characters' end, or the next label."""

    def value(tail: Column) -> Column:
        whole = F.substring(F.substring_index(tail, "\n", 1) if one_line else tail, 1, most)

        def decide(chunk: Column) -> Column:
            left = _strip(F.regexp_replace(chunk, R.BLANK_RUN, " "), " \t:ः-–—")
            plain = F.regexp_replace(chunk, r"\A[ \t:ः–—\-]+", "")
            found = F.when(chunk.rlike(R.BLANK_RUN), left).otherwise(plain)
            return F.when(left.rlike("[ऀ-ॿA-Za-z0-9]"), field("found", clean(found), _raw(chunk))).otherwise(field("blank", None, _raw(chunk)))

        return let(let(whole, lambda c: _until(c, R.NEXT_LABEL, c, 2)), decide)

    return let(_after(text, label), lambda tail: F.when(tail.isNull(), field("absent")).otherwise(value(tail)))


def letter_number(text: Column) -> Column:
    """What stands before a fill-in run and has a digit; else blank."""

    def decide(f: Column) -> Column:
        head = clean(F.regexp_replace(F.element_at(F.split(F.coalesce(f["raw"], F.lit("")), R.BLANK_RUN), 1), r"\A[ \t:ः–—\-]+", ""))
        sure = F.when(head.rlike(R.DIGIT), field("found", F.regexp_replace(head, r"[/,. ]+\z", ""), f["raw"])).otherwise(field("blank", None, f["raw"]))
        return F.when(f["state"] == "found", sure).otherwise(f)

    return let(labelled(text, R.NUMBER_LABEL), decide)


def date(text: Column) -> Column:
    """ISO if it parses; raw if it has digits; else blank."""

    def decide(f: Column) -> Column:
        iso = T.iso_date(f["value"])
        sure = F.when(iso.isNotNull(), field("found", iso, f["raw"])).when(f["value"].rlike(R.DIGIT), f).otherwise(field("blank", None, f["raw"]))
        return F.when((f["state"] == "found") & (f["value"] != ""), sure).otherwise(f)

    return let(labelled(text, R.DATE_LABEL), decide)


def branch(text: Column) -> Column:
    """The first code after a number label and a slash that is neither a number nor a date label."""
    pattern = rf"{R.NUMBER_LABEL}[^\n]{{0,60}}?/\s*([ऀ-ॿ]{{1,12}}[०-९0-9]*[००]?)"
    codes = F.transform(F.regexp_extract_all(text, F.lit(R.FLAGS + pattern), F.lit(1)), clean)
    good = F.filter(codes, lambda c: (c != "") & ~c.rlike(r"^(?:दिनांक|दिनंाक|दिनाक)$|^[0-9०-९]+$"))
    return let(good, lambda g: F.when(F.size(g) > 0, field("found", F.element_at(g, 1), F.element_at(g, 1))).otherwise(field("absent")))


def subject(text: Column) -> Column:
    """Up to the first sentence's end, 300 characters at most."""
    cut = lambda v: F.substring(F.regexp_replace(F.element_at(F.split(v, r"।|\n\s*\n|\n(?=\s*(?:प्रसंग|संदर्भ|मह))"), 1), r"(?U)\A\s+|\s+\z", ""), 1, 300)
    return let(labelled(text, r"(?:विषय|Sub(?:ject)?)", 400, False), lambda f: F.when((f["state"] == "found") & (f["value"] != ""), field("found", cut(f["value"]), f["raw"])).otherwise(f))


def _block(text: Column, begin: str, stop: str, most: int, lines: int, raw: int) -> Column:
    """The non-empty lines after a match, until another or for ``most`` characters, joined by slashes."""

    def value(tail: Column) -> Column:
        part = _until(tail, stop, F.substring(tail, 1, most))
        kept = F.filter(F.transform(F.split(part, _LINES), clean), lambda x: x != "")
        return F.when(F.size(kept) == 0, field("blank")).otherwise(field("found", F.array_join(F.slice(kept, 1, lines), " / "), F.substring(F.regexp_replace(part, r"(?U)\A\s+|\s+\z", ""), 1, raw)))

    return let(_after(text, begin), lambda tail: F.when(tail.isNull(), field("absent")).otherwise(value(tail)))


def addressee(text: Column) -> Column:
    return _block(text, r"^[ \t]*(?:सेवा\s*में|प्रति|प्रेषिती|To)\s*[,ः:]?[ \t]*$", r"^[ \t]*(?:विषय|प्रसंग|संदर्भ|सन्दर्भ|मह(?:ोदय|ाशय)|Sub)", 400, 5, 300)


def signatory(text: Column) -> Column:
    """The lines after the closing; of several closings the one that is first in this order counts."""
    forms = [r"विश्वासभाजन", r"भवदीय(?:ा)?", r"हस्ताक्षर(?:ित)?"]
    out = None
    for p in forms:
        one = _block(text, p, r"^[ \t]*(?:प्रतिलिपि|अनु\s*[०0]|Copy)", 250, 3, 200)
        out = F.when(R.search(text, p), one) if out is None else out.when(R.search(text, p), one)
    return out.otherwise(field("absent"))


def office(text: Column, sign: Column) -> Column:
    """From the first six lines, the signature, or lines seven to fourteen."""
    is_office = lambda x: x.rlike(R.OFFICE_WORDS)
    lines = F.transform(F.slice(F.split(text, _LINES), 1, 14), clean)
    one = lambda xs: F.try_element_at(F.filter(xs, is_office), F.lit(1))
    top, low = one(F.slice(lines, 1, 6)), one(F.slice(lines, 7, 8))
    named = F.when(sign["state"] == "found", one(F.split(sign["value"], " / ")))
    return F.when(top.isNotNull(), field("found", top, top)).when(named.isNotNull(), field("found", clean(named), sign["raw"])).when(low.isNotNull(), field("found", low, low)).otherwise(field("absent"))


def extract(text: Column) -> Column:
    """struct of the nine fields."""
    sign = signatory(text)
    parts = {
        "letter_number": letter_number(text), "branch": branch(text), "date": date(text), "subject": subject(text),
        "reference": labelled(text, r"(?:प्रसंग|संदर्भ|सन्दर्भ|Ref(?:erence)?)"), "addressee": addressee(text), "signatory": sign,
        "office": let(sign, lambda s: office(text, s)), "copy_to": labelled(text, r"(?:प्रतिलिपि|Copy\s+to)", 300, False),
    }
    return F.struct(*(parts[n].cast(_KIND).alias(n) for n in NAMES))


def tally(fields: DataFrame, column: str = "fields") -> DataFrame:
    """(field, found, blank, absent, usable) over all letters."""
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"{column}.{n}.state").alias("state")) for n in NAMES))
    rows = fields.select(F.explode(pairs).alias("x")).select("x.*")
    n = lambda s: F.count_if(F.col("state") == s)
    out = rows.groupBy("field").agg(n("found").alias("found"), n("blank").alias("blank"), n("absent").alias("absent"), F.count("*").alias("n"))
    return out.select("field", "found", "blank", "absent", F.round((F.col("found") + F.col("blank")) / F.col("n"), 6).alias("usable"))
