"""Drafting: prompt budgets, exemplar bodies, assembly, and what needs a second look. Generation is an injected function."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import classify

CONTEXT, RESERVE, LEAST, FERTILITY, EXEMPLARS, EXEMPLAR_TOKENS, THIN = 4096, 900, 256, 1.97, 3, 260, 30
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def prompt_limit(context: int = CONTEXT, reserve: int = RESERVE) -> int:
    return max(LEAST, context - reserve)


def exemplar_body(col: Column | str) -> Column:
    """The lines between the salutation (else the last subject line) and the first closing; all if none are left."""
    c = F.col(col) if isinstance(col, str) else col

    def middle(lines: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(lines))
        where = lambda p: F.filter(at, lambda i: R.search(F.element_at(lines, i), p))
        first = F.coalesce(F.try_element_at(where(r"मह(?:ोदय|ाशय)|^\s*Sir\b"), F.lit(1)), F.try_element_at(where(r"विषय\s*[:ः\-–]"), F.lit(-1)), F.lit(0))
        ends = where(r"विश्वासभाजन|भवदीय|हस्ताक्षर|प्रतिलिपि|अनु\s*[०0]")
        last = F.coalesce(F.try_element_at(F.filter(ends, lambda i: i > first), F.lit(1)), F.size(lines) + 1)
        return F.array_join(F.slice(lines, first + 1, F.greatest(last - first - 1, F.lit(0))), "\n")

    strip = lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
    return T.let(strip(T.let(F.split(c, _LINES), middle)), lambda b: F.when(b != "", b).otherwise(strip(c)))


_COUNTS = [(re.compile("[ऀ-ॣ०-९ॲ-ॿ]+"), None), (re.compile("[A-Za-z]+"), 1.3)]
_DIGIT, _PUNCT = re.compile("[0-9]"), re.compile(r"[^\w\s]")


def _tokens(text: str, fertility: float) -> int:
    total = len(_DIGIT.findall(text)) / 2 + len(_PUNCT.findall(text)) * 0.5
    return int(sum(len(p.findall(text)) * (w or fertility) for p, w in _COUNTS) + total) + 8


def truncate(text: str, limit: int, fertility: float = FERTILITY) -> str:
    """The longest run of leading words within a token limit, with an ellipsis if words are gone."""
    if _tokens(text, fertility) <= limit:
        return text
    words, lo, hi = text.split(), 0, len(text.split())
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if _tokens(" ".join(words[:mid]), fertility) <= limit else (lo, mid - 1)
    return " ".join(words[:lo]) + " …"


def build_prompt(request: Column | str, subject: Column | str, exemplars: Column | str) -> Column:
    """struct(prompt, tokens, dropped): up to three exemplar bodies and the request; the last exemplars go until it fits, but one stays."""
    return F.pandas_udf(_prompts, "struct<prompt:string,tokens:int,dropped:int>")(request, subject, exemplars)


def _prompts(request: pd.Series, subject: pd.Series, exemplars: pd.Series) -> pd.DataFrame:
    out = []
    for q, s, ex in zip(request, subject, exemplars, strict=True):
        bodies = [truncate(x, EXEMPLAR_TOKENS) for x in list(ex if ex is not None else [])[:EXEMPLARS]]
        had = len(bodies)
        while True:
            parts = [f"--- Example {i} ---\n{b}" for i, b in enumerate(bodies, 1)]
            parts += [f"--- Subject ---\n{s}"] if s else []
            prompt = "\n\n".join([*parts, "--- Request ---", (q or "").strip(), "--- Write the body paragraphs in Hindi ---"])
            n = _tokens(prompt, FERTILITY)
            if n <= prompt_limit() or len(bodies) <= 1:
                break
            bodies.pop()
        out.append((prompt, n, had - len(bodies)))
    return pd.DataFrame(out, columns=["prompt", "tokens", "dropped"])


def generate(requests: DataFrame, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """requests (..., prompt) with reply, by a function from prompts to texts that each worker calls on batches."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            yield df.assign(reply=model(list(df.prompt)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(run, f"{schema}, reply string")


def assemble(body: Column, before: Column, salute: Column, after: Column, subject: Column, number: Column, on: Column) -> Column:
    """A letter: the skeleton's head with number and date filled in, subject, salutation, body, and the skeleton's end."""
    said = F.transform(F.split(body, _LINES), F.trim)
    slot, fresh = "-" * 20, lambda xs: F.filter(xs, lambda x: ~F.array_contains(said, F.trim(x)))

    def fill(x: Column) -> Column:
        y = F.regexp_replace(x, R.BLANK_RUN, slot)
        y = F.when(number.isNull(), y).otherwise(F.regexp_replace(y, F.lit(rf"(पत्रांक|ज्ञापांक)\s*[:ः–\-]?\s*{slot}"), F.concat(F.lit("$1- "), number)))
        y = F.when(on.isNull(), y).otherwise(F.regexp_replace(y, F.lit(rf"(दिनांक)\s*[:ः–\-]?\s*{slot}"), F.concat(F.lit("$1 "), on)))
        return F.when(x.rlike("पत्रांक|ज्ञापांक|दिनांक"), y).otherwise(x)

    none = F.array().cast("array<string>")
    head = F.transform(F.filter(fresh(F.coalesce(before, none)), lambda x: ~x.rlike(r"^\s*विषय")), fill)
    title = F.when(F.coalesce(subject, F.lit("")) != "", F.array(F.concat(F.lit("विषय:- "), F.regexp_replace(subject, "।+\\z", ""), F.lit("।")))).otherwise(none)
    end = F.when(F.size(F.coalesce(after, none)) > 0, after).otherwise(F.array(F.lit("विश्वासभाजन")))
    text = F.array_join(F.concat(head, title, fresh(F.coalesce(salute, none)), F.array(F.lit(""), F.trim(body), F.lit("")), end), "\n")
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def needs_review(invented: Column, truncated: Column, verdict: Column, sources: Column, letters: Column) -> Column:
    """Whether a person must look: invented numbers, a cut reply, poor text, no source, or too few letters."""
    return (F.size(invented) > 0) | truncated | (verdict != "clean") | (sources == 0) | (letters < THIN)


def classify_requests(requests: DataFrame, classifier: classify.TrainedClassifier | None = None) -> DataFrame:
    """requests (doc, text) -> (doc, department, department_source, letter_type, letter_type_source): by rules first, by the model where they say nothing."""
    b = classify.by_rules(requests.select("doc", "text"), "b")
    rules = b.select("doc", *(x for c in ("department", "letter_type") for x in (F.nullif(F.col(f"b.{c}"), F.lit(R.UNLABELLED)).alias(c), F.col(f"b.{c}_source").alias(f"{c}_source"))))
    rules = rules.withColumns({f"{c}_source": F.when(F.col(c).isNull(), "none").otherwise(F.col(f"{c}_source")) for c in ("department", "letter_type")})
    if classifier is None:
        return rules
    p = classifier.predict(requests.select("doc", "text"))
    p = p.select("doc", *(F.col(c).alias(f"_{c}") for c in p.columns if c != "doc"))
    both = rules.join(p, "doc", "left")
    said = lambda c: F.concat(F.lit("model ("), F.format_number(F.col(f"_{c}_confidence"), 2), F.lit(")"))
    return both.select(
        "doc", *(x for c in ("department", "letter_type") for x in (F.coalesce(c, F.col(f"_{c}")).alias(c), F.when(F.col(c).isNull() & F.col(f"_{c}").isNotNull(), said(c)).otherwise(F.col(f"{c}_source")).alias(f"{c}_source")))
    )


def draft(requests: DataFrame, retrieved: DataFrame, skeletons: DataFrame, model: Callable[[list[str]], list[str]], letters: int) -> DataFrame:
    """Drafts for requests (id, request, subject, cell, number, on).

    retrieved: (id, rank, text) exemplars; skeletons: (cell, before, salutation, after), of
    which '' is the fallback cell.
    """
    ex = retrieved.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", exemplar_body("text").alias("t")))).alias("x"))
    rows = requests.join(ex, "id", "left").withColumn("exemplars", F.transform(F.coalesce("x", F.array().cast(ex.schema["x"].dataType)), lambda r: r["t"])).drop("x")
    rows = rows.withColumn("p", build_prompt("request", "subject", "exemplars")).select(*rows.columns, "p.*")
    done = generate(rows, model)
    text, removed = T.clean_body("reply")
    done = done.withColumn("body", text).withColumn("removed", removed)
    done = done.withColumn("invented", T.unsupported_numbers("body", F.concat_ws(" ", F.col("request"), F.array_join("exemplars", " "))))
    own = skeletons.withColumn("_own", F.lit(True))
    fallback = skeletons.where("cell = ''").select(*(F.col(c).alias(f"_{c}") for c in ("before", "salutation", "after"))).limit(1)
    done = done.join(own, "cell", "left").join(F.broadcast(fallback), F.lit(True), "left")
    pick = lambda c: F.when(F.col("_own"), F.col(c)).otherwise(F.col(f"_{c}"))
    done = done.withColumn("letter", assemble(F.col("body"), pick("before"), pick("salutation"), pick("after"), F.col("subject"), F.col("number"), F.col("on")))
    cuts, rest, strict = T.QUALITY_CUTS
    done = done.withColumn("verdict", T.bucket(T.quality("body"), cuts, rest, strict))
    return done.withColumn("needs_review", needs_review(F.col("invented"), F.lit(False), F.col("verdict"), F.size("exemplars"), F.lit(letters))).drop("_own", "_before", "_salutation", "_after")
