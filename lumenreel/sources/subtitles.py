"""Subtitle and script formats: text columns in, rows out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.functions import text as T
from lumenreel.functions import times

TIMING = r"^\d{2}:\d{2}:\d{2},\d{3}\s+-->\s+\d{2}:\d{2}:\d{2},\d{3}$"
# Labels of silence in aligned words.
SILENCE = ("", "sp", "sil", "<eps>")


def parse_srt(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, index, start_ms, end_ms, text, error): a row for each block of a subtitle text.

    The line with the cue's number may be missing; then the block's number stands for it. A block
    that is incomplete, has no valid times, ends before it starts or has no text says so in `error`.
    An empty or null text is one row with an error.
    """
    plain = F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"), F.lit("\ufeff \t\n"))
    blocks = df.select(F.col(key), F.posexplode(F.split(plain, r"\n\s*\n")).alias("block", "body"))
    tidy = F.transform(F.split("body", "\n"), lambda x: F.rtrim(x))
    rows = blocks.withColumn("block", F.col("block") + 1).withColumn("l", F.split(F.btrim(F.array_join(tidy, "\n"), F.lit("\n")), "\n"))
    numbered = F.regexp_like(F.trim(F.element_at("l", 1)), F.lit(r"^\d+$")) & (F.size("l") >= 2)
    rows = rows.withColumn("numbered", numbered)
    timing = F.trim(F.when(F.col("numbered"), F.try_element_at("l", F.lit(2))).otherwise(F.element_at("l", 1)))
    body = F.trim(F.array_join(F.slice("l", F.when(F.col("numbered"), 3).otherwise(2), F.size("l")), "\n"))
    side = lambda k: times.parse_stamp(F.trim(F.try_element_at(F.split("timing", r"\s+-->\s+"), F.lit(k))))
    rows = rows.select(
        key, "block", F.when(F.col("numbered"), F.trim(F.element_at("l", 1)).try_cast("int")).otherwise(F.col("block")).alias("index"),
        F.size("l").alias("n"), F.element_at("l", 1).alias("first"), timing.alias("timing"), body.alias("text"),
    ).withColumns({"start_ms": F.when(F.regexp_like("timing", F.lit(TIMING)), side(1)), "end_ms": F.when(F.regexp_like("timing", F.lit(TIMING)), side(2))})
    error = (
        F.when((F.col("n") == 1) & (F.col("first") == ""), F.lit("The text is empty."))
        .when(F.col("n") < 2, F.lit("The block is incomplete."))
        .when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), F.lit("The timing line is not valid."))
        .when(F.col("end_ms") < F.col("start_ms"), F.lit("The cue ends before it starts."))
        .when(F.col("text") == "", F.lit("The cue has no text."))
    )
    return rows.select(key, "block", "index", "start_ms", "end_ms", "text", error.alias("error"))


def assert_valid(cues: DataFrame) -> DataFrame:
    """The cues without `error`; a cue that has one stops the job with the block's number."""
    said = F.concat(F.lit("SRT block "), F.col("block").cast("string"), F.lit(": "), F.col("error"))
    return cues.where(F.when(F.col("error").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)).drop("error")


def _document(cues: DataFrame, key: str, position: str, block: Column, between: str) -> DataFrame:
    rows = cues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), block.alias("b")))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda r: r["b"]), between).alias("text"))


def render_srt(cues: DataFrame, key: str, position: str, number: Column | None = None) -> DataFrame:
    """(key, text): the subtitle text of each document; cues are numbered by `number`, else from 1."""
    from lumenreel.tables import running

    rows = cues if number is not None else running(cues, [key], [position], "_n")
    n = number if number is not None else F.col("_n")
    block = F.concat(n.cast("string"), F.lit("\n"), times.format_stamp(F.col("start_ms")), F.lit(" --> "), times.format_stamp(F.col("end_ms")), F.lit("\n"), F.col("text"))
    out = _document(rows, key, position, block, "\n\n")
    return out.withColumn("text", F.concat("text", F.lit("\n")))


def render_text(cues: DataFrame, key: str, position: str) -> DataFrame:
    """(key, text): '[number] start --> end' lines, each followed by its text."""
    block = F.concat(F.lit("["), F.col(position).cast("string"), F.lit("] "), times.format_stamp(F.col("start_ms")), F.lit(" --> "), times.format_stamp(F.col("end_ms")), F.lit("\n"), F.col("text"))
    return _document(cues, key, position, block, "\n")


def parse_textgrid(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, word, start, end) of the tier called words; silence and unreadable times are left out."""
    tier = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r'(?s)name = "words"(.*?)(?:item \[\d+\]|\z)', 1)
    every = r'xmin = ([-\d.eE+]+)\s*xmax = ([-\d.eE+]+)\s*text = "((?:[^"]|"")*)"'
    part = lambda k: F.regexp_extract_all(tier, F.lit(every), F.lit(k))
    rows = df.select(key, F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("w"))).alias("position", "x"))
    out = rows.select(key, "position", F.trim(F.replace("x.w", F.lit('""'), F.lit('"'))).alias("word"), F.col("x.a").try_cast("double").alias("start"), F.col("x.b").try_cast("double").alias("end"))
    return out.where(~F.lower("word").isin(*SILENCE) & F.col("start").isNotNull() & F.col("end").isNotNull())


def read_scripts(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content) that are plain text or word-processor documents.

    Text is read as UTF-8 and, where it isn't, as the code page that holds every byte. Of a document
    the paragraphs with text are joined by empty lines. One file at a time is held.
    """

    def run(batches):
        import io
        import zipfile
        from xml.etree import ElementTree

        import pandas as pd

        space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"].tolist(), pdf["content"].tolist(), strict=True):
                if path.lower().endswith(".docx"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        root = ElementTree.fromstring(z.read("word/document.xml"))
                    paras = ("".join(t.text or "" for t in p.iter(space + "t")).strip() for p in root.iter(space + "p"))
                    out.append((path, "\n\n".join(p for p in paras if p)))
                    continue
                for coding in ("utf-8-sig", "cp1252", "latin-1"):
                    try:
                        out.append((path, content.decode(coding)))
                        break
                    except UnicodeDecodeError:
                        continue
            yield pd.DataFrame(out, columns=["path", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def words_of_cues(cues: DataFrame, key: str) -> DataFrame:
    return cues.select(key, F.explode(T.words(F.col("text"))).alias("word"))
