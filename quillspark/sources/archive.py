"""Reading an archive: files of many formats become documents of blocks of runs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ["docx", "doc", "dot", "rtf", "pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp"]
IMAGES = SUFFIXES[5:]
BLOCKS = "array<array<struct<text:string,font:string>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def walk(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, kind, error): the archive's files of known suffixes; lock files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return route(files.where(suffix(F.col("path")).isin(SUFFIXES) & ~F.col("path").rlike(r"/(?:~|%7E)\$[^/]*$")).select("path", "content"))


def route(files: DataFrame) -> DataFrame:
    """Files with kind (docx, pdf, image) or error: why a file is refused is a row's column, not an exception."""
    s, magic = suffix(F.col("path")), F.hex(F.substring("content", 1, 4))
    kind = F.when(s == "docx", "docx").when(s == "pdf", "pdf").when(s.isin(IMAGES), "image")
    error = (
        F.when(s.isin("doc", "dot"), F.when(magic == "D0CF11E0", "legacy binary document: save it as docx").otherwise("not a document of the old format either"))
        .when(s == "rtf", "rich text: save it as docx").when(kind.isNull(), "unsupported format")
    )
    return files.withColumn("kind", kind).withColumn("error", error)


def _font(props, names=("ascii", "hAnsi", "cs")) -> str | None:
    fonts = None if props is None else props.find(f"{_W}rFonts")
    return None if fonts is None else next((fonts.get(_W + n) for n in names if fonts.get(_W + n)), None)


def docx_blocks(content: bytes) -> tuple[list, list[str]]:
    """(blocks, warnings) of a docx: runs that are direct children of paragraphs, each with its resolved font."""
    warnings: list[str] = []
    z = zipfile.ZipFile(io.BytesIO(content))
    styles, default = {}, None
    try:
        root = ElementTree.fromstring(z.read("word/styles.xml"))
        default = _font(root.find(f"{_W}docDefaults/{_W}rPrDefault/{_W}rPr"))
        styles = {s.get(f"{_W}styleId"): _font(s.find(f"{_W}rPr")) for s in root.iter(f"{_W}style")}
    except KeyError:
        pass
    except ElementTree.ParseError:
        warnings.append("styles can't be read")
    blocks = []
    for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{_W}p"):
        of = p.find(f"{_W}pPr/{_W}pStyle")
        below = (styles.get(of.get(f"{_W}val")) if of is not None else None) or default
        runs = []
        for r in p.findall(f"{_W}r"):
            props = r.find(f"{_W}rPr")
            named = None if props is None else props.find(f"{_W}rStyle")
            font = _font(props) or (styles.get(named.get(f"{_W}val")) if named is not None else None) or below
            text = "".join(x.text or "" if x.tag == f"{_W}t" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "\t" if x.tag == f"{_W}tab" else "" for x in r)
            if text:
                runs.append({"text": text, "font": font})
        if runs:
            blocks.append(runs)
    if not blocks:
        warnings.append("no text")
    return blocks, warnings


def read_docx(files: DataFrame) -> DataFrame:
    """(path, blocks, warnings, error) of the docx among the files; one that can't be read has an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for path, content in zip(df.path, df.content, strict=True):
                try:
                    out.append((path, *docx_blocks(bytes(content)), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((path, [], [], f"unreadable: {e}"))
            yield pd.DataFrame(out, columns=["path", "blocks", "warnings", "error"])

    return files.where("kind = 'docx'").select("path", "content").mapInPandas(run, f"path string, blocks {BLOCKS}, warnings array<string>, error string")


def text_blocks(text: Column) -> Column:
    """Plain text as blocks of one run without a font: a line each, form feeds as line ends, blank lines limited."""
    lines = F.split(F.regexp_replace(F.replace(text, F.lit("\f"), F.lit("\n")), r"\n{3,}", "\n\n"), "\n", -1)
    return F.transform(lines, lambda x: F.array(F.struct(x.alias("text"), F.lit(None).cast("string").alias("font"))))


def read_text(files: DataFrame) -> DataFrame:
    """(path, blocks) of files that hold text: UTF-8 with or without a mark, UTF-16, or Windows-1252."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        def one(b) -> str | None:
            for name in ("utf-8-sig", "utf-16", "cp1252"):
                try:
                    t = bytes(b).decode(name)
                    if "�" not in t:
                        return t
                except UnicodeError:
                    continue
            return None

        return s.map(one)

    return files.select("path", text_blocks(decode("content")).alias("blocks"))


def from_text(spark: SparkSession, text: str, name: str = "-") -> DataFrame:
    """(path, blocks) of a single text, such as standard input."""
    return spark.createDataFrame([(name, text)], "path string, text string").select("path", text_blocks(F.col("text")).alias("blocks"))


def tools(names: tuple[str, ...] = ("tesseract", "pdftotext", "pdftoppm")) -> dict[str, str | None]:
    """Where this machine has the programs that scanned files need, if it has them."""
    import shutil

    return {n: shutil.which(n) for n in names}


def languages(listing: str) -> list[str]:
    """The languages that an OCR program says it knows: a heading, then one a line."""
    return sorted({x.strip() for x in listing.splitlines()[1:] if x.strip() and " " not in x.strip()})


def read_with(files: DataFrame, kind: str, reader) -> DataFrame:
    """(path, text, confidence, error) of the files of a kind by a function from bytes to (text, confidence), such as an OCR program's."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for path, content in zip(df.path, df.content, strict=True):
                try:
                    out.append((path, *reader(bytes(content)), None))
                except Exception as e:  # a file that can't be read is a row, not the job's end
                    out.append((path, None, None, f"unreadable: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "confidence", "error"])

    return files.where(F.col("kind") == kind).select("path", "content").mapInPandas(run, "path string, text string, confidence double, error string")


def font_histogram(docs: DataFrame) -> DataFrame:
    """(font, chars, share) over the archive."""
    runs = docs.select(F.explode(F.flatten("blocks")).alias("r")).groupBy(F.coalesce("r.font", F.lit("?")).alias("font")).agg(F.sum(F.length("r.text")).alias("chars"))
    return runs.crossJoin(F.broadcast(runs.agg(F.sum("chars").alias("t")))).select("font", "chars", F.round(F.col("chars") / F.col("t"), 4).alias("share"))


#: What makes a text layer too thin or too poor, and the confidence at which OCR counts for nothing and for its span.
THIN_CHARS, POOR_QUALITY, OCR_FLOOR, OCR_SPAN = 120, 0.80, 60, 40


def pdf_route(chars: Column, pages: Column, quality: Column, forced: Column) -> Column:
    """ocr, text-layer: OCR if it is forced, or the text layer is thin or poor."""
    return F.when(forced | (chars < THIN_CHARS * F.greatest(pages, F.lit(1))) | (quality < POOR_QUALITY), "ocr").otherwise("text-layer")


def ocr_confidence(mean: Column, tier: Column) -> Column:
    """What a text's confidence is multiplied with: 1 unless it was read by OCR."""
    return F.when(tier != "ocr", 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean - OCR_FLOOR) / OCR_SPAN)))


def page_confidence(words: DataFrame) -> DataFrame:
    """(path, pages, mean_word_confidence, low_share): the mean of the pages' medians. words: (path, page, conf)."""
    pages = words.groupBy("path", "page").agg(F.percentile("conf", F.lit(0.5)).alias("m"), F.count_if(F.col("conf") < OCR_FLOOR).alias("low"), F.count("*").alias("n"))
    return pages.groupBy("path").agg(F.count("*").alias("pages"), F.round(F.avg("m"), 6).alias("mean_word_confidence"), F.round(F.sum("low") / F.sum("n"), 6).alias("low_share"))


def archive_bucket(path: Column, fonts: Column, n_blocks: Column, error: Column) -> Column:
    """scanned, legacy, unicode, or why a file needs help first."""
    legacy = F.exists(fonts, lambda f: F.lower(f).rlike("kruti|devlys"))
    return F.when(error.isNotNull() & suffix(path).isin("doc", "dot", "rtf"), F.concat(suffix(path), F.lit("-needs-conversion"))).when(error.isNotNull(), "unreadable").when(n_blocks == 0, "scanned").when(legacy, "legacy").otherwise("unicode")


def gold_pairs(spark: SparkSession, path: str, table: str = "krutidev010") -> DataFrame:
    """(legacy, expected, table, note) of a TSV; a # that no TAB follows begins a comment."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^#(?!\t)|^\s*$")).select(F.split("value", "\t").alias("p")).where("size(p) >= 2")
    return rows.select(F.col("p")[0].alias("legacy"), F.col("p")[1].alias("expected"), F.coalesce(F.nullif(F.try_element_at("p", F.lit(3)), F.lit("")), F.lit(table)).alias("table"), F.try_element_at("p", F.lit(4)).alias("note"))


def latest_files(files: DataFrame, order: str = "precedence") -> DataFrame:
    """Of files of one name the one whose folder comes last."""
    return files.groupBy("name").agg(F.max_by(F.struct(*files.columns), order).alias("f")).select("f.*")


def effort_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(request, letter) of a TSV with # comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema="request string, letter string").where("request is not null and letter is not null")


def skeleton_files(spark: SparkSession, folder: str) -> DataFrame:
    """(department, letter_type, before, salutation, after) of corrected skeletons: Markdown with a heading and three sections."""
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    head = r"\A\s*#\s*([^/\n]+?)\s*/\s*([^(\n]+?)\s*\("
    part = lambda n: F.filter(F.transform(F.split(F.coalesce(F.try_element_at(F.split("value", r"(?m)^##[^\n]*\n"), F.lit(n)), F.lit("")), "\n"), F.trim), lambda x: x != "")
    return text.where(F.col("value").rlike(head)).select(F.regexp_extract("value", head, 1).alias("department"), F.regexp_extract("value", head, 2).alias("letter_type"), part(2).alias("before"), part(3).alias("salutation"), part(4).alias("after"))
