"""Toxicity by a classifier chain over linear models.

Categories: the tables tell toxic from not, and each text's language, so the chain has a
category ``toxic in`` a language for each of the ``LINKS`` languages with the most toxic
rows of the sample, and then ``toxic`` itself. Each link is a linear model of the features
and of the probabilities of the categories before it; in training those are out of fold,
from models that did not see the row.

Features: how often a text has each of ``GRAMS`` character n-grams (of lower-case words and
the spaces at their ends, in MIN_SHARE of the toxic rows) that mark toxic rows best. A fold's model has
its own n-grams, chosen without the fold, so the out-of-fold probabilities, and the cut that
is chosen from them, have seen nothing of the rows that they are for.

The sample is the ``SAMPLE`` labelled doc_ids with the least hash, a bound that holds the
driver's share constant; scores cover every text in full.

Cases: a null or empty text scores like one without marks; a very long text is read whole,
and a mark counts up to ``SEEN`` times in any text; texts with equal counts tie, and one at
the cut is toxic; without labelled rows of both kinds, or n-grams that mark the toxic ones,
nothing is toxic; rows that repeat a doc_id are scored each, but learned from once (by their
least text and the greatest of the doc_id's labels); without a column lang, or where it is
null, a row is of no language; an empty table gives no rows; further columns are kept by
``keep_clean`` and ignored else.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .linear import apply_logistic, fit_logistic, sample

SAMPLE, GRAMS, FOLDS, MIN_ROWS, MIN_SHARE, RIDGE = 8000, 256, 3, 3, 0.02, 1.0
SIZES = (4, 6, 8)
#: Languages that are categories.
LINKS = 4
#: Toxic rows that it takes to choose a cut.
ENOUGH = 100
#: Occurrences of a mark that tell: one is as sure a sign in a long text as many are.
SEEN = 3
_APART = regex.compile(r"\P{L}+")


def spaced(text: str | None) -> str:
    """The text's words, lower-case, with a space before and after each."""
    return f" {_APART.sub(' ', (text or '').lower())} "


def grams(text: str | None) -> set[str]:
    """The distinct n-grams of a text's words and the spaces around them."""
    out: set[str] = set()
    for x in set(spaced(text).split()):
        w = f" {x} "
        for n in SIZES:
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def fold_of(doc_id) -> F.Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each n-gram and fold, the rows that have it and the toxic ones among them."""
    every, toxic = [Counter() for _ in range(FOLDS)], [Counter() for _ in range(FOLDS)]
    for b in batches:
        for t, y, f in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
            g = grams(t)
            every[f].update(g)
            if y:
                toxic[f].update(g)
    keys = list(set().union(*every))
    for i in range(0, len(keys), 50_000):
        k = keys[i : i + 50_000]
        yield pa.record_batch([pa.array(k), *(pa.array([c[x] for x in k], pa.int64()) for c in (*every, *toxic))], names=["g", *(f"n{f}" for f in range(FOLDS)), *(f"t{f}" for f in range(FOLDS))])


def choose_marks(counted: DataFrame, folds: list[int], rows: int, toxic: int) -> list[str]:
    """The n-grams that mark toxic rows best, by the counts of these folds alone."""
    n, t = (sum((F.col(f"{c}{f}") for f in folds), F.lit(0)) for c in "nt")
    share = toxic / max(rows, 1)
    score = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share + 1)
    some = counted.select("g", n.alias("n"), t.alias("t")).where((F.col("t") >= max(MIN_ROWS, MIN_SHARE * toxic)) & (F.col("t") > 0.3 * F.col("n")))
    return sorted(r.g for r in some.orderBy(score.desc(), "g").limit(GRAMS).select("g").collect())


def _automaton(marks: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, g in enumerate(marks):
        a.add_word(g, i)
    if marks:
        a.make_automaton()
    return a


def occurrences(texts: list[str | None], marks: list[str], automaton: ahocorasick.Automaton) -> np.ndarray:
    """How often each mark is in each text, up to SEEN."""
    x = np.zeros((len(texts), len(marks)), dtype=np.uint8)
    if marks:
        for row, t in enumerate(texts):
            for k, n in Counter(k for _, k in automaton.iter(spaced(t))).items():
                x[row, k] = min(n, SEEN)
    return x


def features(x: np.ndarray) -> np.ndarray:
    return np.log1p(x.astype(np.float64))


class Chain:
    """The models, in order; weights[i] is for the features, i earlier probabilities, and 1. A text is toxic from the threshold on."""

    def __init__(self, marks: list[str], weights: list[np.ndarray], threshold: float = 0.5, languages: tuple[str, ...] = ()):
        self.marks, self.weights, self.threshold, self.languages = marks, weights, threshold, languages

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages' categories, then of toxic."""
        p = np.zeros((len(x), 0))
        for w in self.weights:
            p = np.hstack([p, apply_logistic(np.hstack([x, p]), w)[:, None]])
        return p


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(weights of each link, out-of-fold probabilities of each).

    labels: rows by categories. columns[f] are the features of the models that do not see
    fold f, and the last entry those of the models that see all rows.
    """
    oof, weights = np.zeros((len(x), 0)), []
    for y in labels.T:
        weights.append(fit_logistic(np.hstack([x[:, columns[-1]], oof]), y, RIDGE))
        p = np.zeros(len(x))
        for f in np.unique(fold):
            inputs = np.hstack([x[:, columns[f]], oof])
            if (fold != f).any():
                p[fold == f] = apply_logistic(inputs[fold == f], fit_logistic(inputs[fold != f], y[fold != f], RIDGE))
        oof = np.hstack([oof, p[:, None]])
    return weights, oof


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of the cuts between out-of-fold probabilities the one of the greatest F1, midway, within a quarter and a half; a half where fewer than ENOUGH rows are toxic."""
    if y.sum() < ENOUGH:
        return 0.5
    o = np.argsort(-p, kind="stable")
    p, y = p[o], y[o]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[np.r_[p[1:] == p[:-1], False]] = -1  # equal probabilities fall on one side
    k = int(f1.argmax())
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 0.25, 0.5))


def fit(documents: DataFrame, labels: DataFrame) -> Chain:
    """A chain fitted on SAMPLE labelled doc_ids at most."""
    rows = sample(documents, labels, "toxic", SAMPLE).withColumn("fold", fold_of(F.col("doc_id"))).repartition(16, "doc_id").persist()
    try:
        sums = {r.fold: (r.n, r.t) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
        n, t = (sum(v[i] for v in sums.values()) for i in (0, 1))
        if not t or t == n:
            return Chain([], [])
        counts = [f"{c}{f}" for c in "nt" for f in range(FOLDS)]
        counted = rows.select("text", "toxic", "fold").mapInArrow(_count, "g string, " + ", ".join(f"{c} long" for c in counts)).groupBy("g").agg(*(F.sum(c).alias(c) for c in counts))
        counted = counted.where(sum((F.col(f"t{f}") for f in range(FOLDS)), F.lit(0)) >= MIN_ROWS).persist()
        every = [choose_marks(counted, [k for k in range(FOLDS) if k != f], *(sum(v[i] for k, v in sums.items() if k != f) for i in (0, 1))) for f in range(FOLDS)]
        every.append(choose_marks(counted, list(range(FOLDS)), n, t))
        counted.unpersist()
        if not every[-1]:
            return Chain([], [])
        union = sorted(set().union(*every))
        auto = _automaton(union)

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = occurrences(b.column("text").to_pylist(), union, auto)
                yield pa.record_batch([*(b.column(c) for c in ("doc_id", "toxic", "lang", "fold")), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "toxic", "lang", "fold", "x"])

        got = rows.select("doc_id", "toxic", "lang", "fold", "text").mapInArrow(vectors, "doc_id long, toxic int, lang string, fold int, x binary").orderBy("doc_id").toPandas()
    finally:
        rows.unpersist()
    at = {g: i for i, g in enumerate(union)}
    x = features(np.frombuffer(b"".join(got.x), dtype=np.uint8).reshape(len(got), len(union)))
    y, lang = got.toxic.to_numpy().astype(float), got.lang.to_numpy()
    languages = tuple(k for k, _ in sorted(Counter(k for k, v in zip(lang, y, strict=True) if v and k is not None).items(), key=lambda z: (-z[1], z[0]))[:LINKS])
    labels_ = np.stack([*(y * (lang == k) for k in languages), y], axis=1)
    weights, oof = fit_chain(x, labels_, got.fold.to_numpy(), [np.array([at[g] for g in marks], dtype=int) for marks in every])
    return Chain(every[-1], weights, best_threshold(oof[:, -1], y), languages)


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    """The documents' columns, then p_language_1 to p_language_LINKS (null where there is no such link) and p_toxic; only texts go to Python, and only scores come back."""
    held: dict = {}
    names = [*(f"language_{i + 1}" for i in range(LINKS)), "toxic"]

    def run(texts: pa.Array) -> pa.Array:
        if "auto" not in held:
            held["auto"] = _automaton(chain.marks)
        found, k = texts.to_pylist(), len(chain.languages)
        p = chain.scores(features(occurrences(found, chain.marks, held["auto"]))) if chain.weights else np.zeros((len(found), 1))
        none = pa.nulls(len(found), pa.float64())
        return pa.StructArray.from_arrays([*(pa.array(p[:, i]) if i < k else none for i in range(LINKS)), pa.array(p[:, k])], names=names)

    call = F.arrow_udf(run, "struct<" + ", ".join(f"{k}: double" for k in names) + ">")
    out = documents.withColumn("_p", call(F.col("text")))
    return out.select(*(F.col(f"`{c}`") for c in documents.columns), *(F.col(f"_p.{k}").alias(f"p_{k}") for k in names))


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with the columns they had."""
    chain = fit(documents, labels)
    return score(documents.withColumn("_keep", F.struct("*")).select("_keep", "text"), chain).where(F.col("p_toxic") < chain.threshold).select("_keep.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), chain).drop("text").withColumn("toxic", F.col("p_toxic") >= chain.threshold)
