"""Readers: text, Markdown, CSV, JSON and file facts. One row per file, line or record; all lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lorespan.functions import text as t
from lorespan.functions.cleaning import remove_html_tags
from lorespan.functions.unicode import decode_html_entities

# Accepted extensions, size limit, MIME types.
EXTENSIONS = ("pdf", "docx", "txt", "md", "csv", "html")
MAX_BYTES = 50 * 1024 * 1024
MIME_TYPES = {
    "txt": "text/plain",
    "text": "text/plain",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "csv": "text/csv",
    "html": "text/html",
    "htm": "text/html",
    "json": "application/json",
    "xml": "text/xml",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "py": "text/x-python",
}
BENCHMARK_SCHEMA = (
    "name string, queries array<struct<query:string, expected_answer:string, expected_documents:array<string>, "
    "metadata:map<string,string>>>"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_files(spark: SparkSession, path: str, glob: str = "*.{txt,text}") -> DataFrame:
    """One document per file: ``path, file_name, text``."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.withColumn("file_name", file_name(F.col("path")))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path, "*.{md,markdown}")


def read_lines(spark: SparkSession, path: str, glob: str = "*.{txt,text}") -> DataFrame:
    """One row per line, trailing blanks removed."""
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), t.rstrip(F.col("value")).alias("line"))


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(t.strip(F.col("line")) == "").alias("empty_lines")
    )


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8", schema: str | None = None):
    """CSV with a header. Give a schema where the data is large: inference reads everything once more."""
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
    reader = reader.option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def html_text(c: Column) -> Column:
    """Visible text: scripts, styles, comments and tags dropped, entities decoded, blanks collapsed."""
    hidden = "(?is)<(script|style|noscript|template)\\b[^>]*>.*?</\\1\\s*>|<!--.*?-->"
    visible = decode_html_entities(remove_html_tags(F.regexp_replace(c, hidden, " ")))
    return t.strip(F.regexp_replace(visible, t.SPACES, " "))


def read_benchmark_json(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark sets ``{name, queries: [...]}``, one row per query."""
    sets = spark.read.schema(BENCHMARK_SCHEMA).option("multiLine", True).json(path)
    return sets.select("name", F.posexplode("queries").alias("n", "q")).select("name", "n", "q.*")


def read_benchmark_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, schema="query string, expected_answer string")
    return rows.withColumn("name", file_name(F.col("_metadata.file_path")))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension."""
    if path.lower().endswith(".json"):
        return read_benchmark_json(spark, path)
    if path.lower().endswith(".csv"):
        return read_benchmark_csv(spark, path)
    raise ValueError(f"unknown benchmark format: {path}")


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``path, file_name, extension, length, modificationTime``; the content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select(
        "path",
        file_name(F.col("path")).alias("file_name"),
        extension(F.col("path")).alias("extension"),
        "length",
        "modificationTime",
    )


def file_facts(
    spark: SparkSession, path: str, recursive: bool = False, algorithm: str = "sha256", max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Facts of every file with MIME type and checksum of the bytes.

    Files over the limit have no checksum but a ``skip_reason``: their branch does not ask for the content, and filters
    on ``length`` are applied by the source before it opens a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    digest = {"sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "sha1": F.sha1, "md5": F.md5}
    if algorithm not in digest:
        raise ValueError(f"unknown algorithm: {algorithm}")
    ext = extension(F.col("path"))
    mime = F.lit("application/octet-stream")
    for name, value in MIME_TYPES.items():
        mime = F.when(ext == name, value).otherwise(mime)

    def facts(rows: DataFrame, checksum: Column, reason: Column) -> DataFrame:
        return rows.select(
            "path",
            file_name(F.col("path")).alias("file_name"),
            ext.alias("extension"),
            mime.alias("mime_type"),
            F.col("length").alias("size"),
            checksum.alias("checksum"),
            reason.alias("skip_reason"),
            F.col("modificationTime").alias("modified_at"),
        )

    none = F.lit(None).cast("string")
    read = facts(files.where(F.col("length") <= max_bytes), digest[algorithm](F.col("content")), none)
    return read.union(facts(files.where(F.col("length") > max_bytes), none, F.lit("File exceeds maximum size.")))


def validate_files(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``reject_reason``: null where the file is accepted. Rejected rows form the quarantine table."""
    return files.withColumn(
        "reject_reason",
        F.when(~F.col("extension").isin(*extensions), F.concat(F.lit("Unsupported file type: ."), F.col("extension")))
        .when(F.col("length") > max_bytes, "File exceeds maximum size."),
    )


def storage_statistics(files: DataFrame) -> DataFrame:
    """Files and bytes by extension."""
    return files.groupBy("extension").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.round(F.sum("length") / (1024 * 1024), 2).alias("megabytes"),
    )


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("modificationTime"), "path")


def search_files(files: DataFrame, keyword: str) -> DataFrame:
    return files.where(t.contains_ci(F.col("file_name"), keyword))
