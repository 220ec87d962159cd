"""Readers: files, pages, queue records, registries, extractions, timelines, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom import schemas
from recordloom.functions import text as tx

#: Names and folders that are no input.
SKIPPED_NAMES = (".ds_store", ".ingest-lock", "thumbs.db", "desktop.ini")
SKIPPED_FOLDERS = ("_failed", "_skipped")
DIRECT_TEXT = ("txt", "csv", "md")
#: Kinds that are no text: a converter makes pages of them.
CONVERTED = ("pdf", "docx", "pptx", "xlsx", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif", "wav", "mp3", "m4a", "ogg", "flac", "mp4", "mov", "avi", "mkv", "webm")


def as_text(content: str) -> Column:
    """Bytes as UTF-8; what is none becomes the replacement character."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def suffix_of(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def incoming(df: DataFrame) -> DataFrame:
    parts = F.split(F.lower("path"), "/")
    name = F.element_at(parts, -1)
    inside = F.exists(parts, lambda p: p.isin(*SKIPPED_FOLDERS))
    return df.where(~name.isin(*SKIPPED_NAMES) & ~F.endswith(name, F.lit(".yml")) & ~inside)


def find(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length of the incoming files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return incoming(files.select("path", "modificationTime", "length"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, sha256, kind, pages of the incoming files: text files are one page, web pages their readable text; other kinds
    have no pages here and are left to a converter (``convert``)."""
    files = incoming(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
    suffix = suffix_of("path")
    raw = as_text("content")
    one = lambda c: F.array(F.struct(F.lit(1).alias("page"), c.alias("markdown")))
    pages = F.when(suffix.isin("html", "xhtml", "htm"), one(tx.html_text(raw))).when(suffix.isin(*CONVERTED), F.lit(None)).otherwise(one(raw))
    return files.select("path", F.sha2("content", 256).alias("sha256"), suffix.alias("kind"), pages.alias("pages"), "content")


def convert(files: DataFrame, converter) -> DataFrame:
    """sha256, pages, error of binary files through ``converter(bytes, kind) -> list of page texts``; a failure is a row."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for sha, kind, content in zip(b["sha256"], b["kind"], b["content"], strict=True):
                try:
                    pages = [{"page": i, "markdown": t.strip()} for i, t in enumerate(converter(content, kind), 1) if t.strip()]
                    rows.append((sha, pages, None))
                except Exception as e:  # a broken file must not end the job
                    rows.append((sha, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["sha256", "pages", "error"])

    return files.select("sha256", "kind", "content").mapInPandas(run, "sha256 string, pages array<struct<page:int,markdown:string>>, error string")


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """path of the file that a ``.yml`` beside it describes, and its fields as a map."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yml").text(folder)
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^\w+:"))
    pairs = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1), F.trim(F.regexp_replace(x, r"^\w+:\s*|[\"']", "")))))
    return raw.select(F.regexp_replace(F.input_file_name(), r"\.yml$", "").alias("path"), pairs.alias("fields"))


def queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue records; what is no record is left out."""
    return spark.read.schema(schemas.QUEUE).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).where("sha256 IS NOT NULL")


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extractions, with the section's number where the file is one of a document's sections."""
    rows = spark.read.schema(schemas.EXTRACTION).option("multiLine", "true").json(path)
    return rows.withColumn("section", F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), r"_(\d+)\.json$", 1), F.lit("")).cast("int"), F.lit(0)))


def registry(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """A registry file (one JSON object by key) as rows key, entry; a corrupt one gives no row."""
    raw = spark.read.option("wholetext", "true").text(path)
    return raw.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("key", "entry"))


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """date, staged (true for a document's own file), line of timeline files ``date[_sha].ndjson``."""
    raw = spark.read.text(path)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.ndjson$", 1)
    return raw.where(F.trim("value") != "").select(F.element_at(F.split(stem, "_"), 1).alias("date"), F.contains(stem, F.lit("_")).alias("staged"), F.col("value").alias("line"))


def skills(spark: SparkSession, path: str) -> DataFrame:
    """name, text of record descriptions, without those whose names begin with an underscore."""
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "[!_]*.md").text(path)
    return raw.select(tx.file_stem(F.input_file_name()).alias("name"), F.col("value").alias("text"))


def skills_digest(rows: DataFrame) -> DataFrame:
    """One row: the digest that invalidates what was computed from the descriptions (a small dimension)."""
    return rows.agg(F.substring(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "text"))), lambda r: r["text"]), "\n"), 256), 1, 16).alias("digest"))


def session_log(spark: SparkSession, path: str) -> DataFrame:
    """agent, model, kind, tokens of the assistant's turns of a session log; blank and broken lines are left out."""
    usage = "struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>"
    rows = spark.read.schema(f"agent string, message struct<role:string,model:string,usage:{usage}>").option("mode", "DROPMALFORMED").json(path)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"message.usage.{c}"), F.lit(0)).alias("tokens")) for k, c in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read_input_tokens"), ("cache_write", "cache_creation_input_tokens"))])
    return rows.where("message.role = 'assistant'").select(F.coalesce("agent", F.lit("main")).alias("agent"), F.col("message.model").alias("model"), F.explode(kinds).alias("k")).select("agent", "model", "k.kind", "k.tokens")
