"""Pages and tables in files of older encodings, one page a file."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, encoding: str, pattern: str = "*", column: str = "html") -> DataFrame:
    """path, ``column`` and the folders' columns of every file below ``path``: its text, decoded from ``encoding``.

    Spark reads and splits by file, so any store it knows will do; bytes that the encoding doesn't have become U+FFFD, and the page is kept.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    rest = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]

    def decode(batches):
        for batch in batches:
            texts = [None if b is None else b.decode(encoding, "replace") for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], [column, *batch.schema.names[1:]])

    kinds = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in ("path", *rest))
    return files.select("content", "path", *rest).mapInArrow(decode, f"{column} string, {kinds}")


def read_lines(spark: SparkSession, path: str, encoding: str, pattern: str = "*") -> DataFrame:
    """path, at, line and the folders' columns of every line of the files below ``path``; ``at`` orders the lines of a file.

    Spark splits files at line feeds, so what a task holds doesn't grow with a file; in ``encoding`` no other character may have the byte of one.
    ``at`` is from where a split begins and the order of reading, so it holds within one run over the rows.
    """
    files = spark.read.option("pathGlobFilter", pattern).option("lineSep", "\n").text(path)
    rest = [c for c in files.columns if c != "value"]
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    raw = files.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), at.alias("at"), *rest)

    def decode(batches):
        for batch in batches:
            texts = [b.decode(encoding, "replace") for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], ["line", *batch.schema.names[1:]])

    kinds = ", ".join(f"{c} {raw.schema[c].dataType.simpleString()}" for c in raw.columns[1:])
    return raw.mapInArrow(decode, f"line string, {kinds}")


def write_pages(lines: DataFrame, path: str, page: str, order: list[str], encoding: str) -> None:
    """Writes ``lines`` (line, ``page`` and ``order``) as one file a page, in folders ``page=value``, in ``encoding``; a page is never one value.

    Spark's sinks know Latin-1 but not the older code pages, so a line's encoded bytes are written as the Latin-1 characters they stand for; what the
    encoding doesn't have becomes a question mark.
    """

    def recode(batches):
        for batch in batches:
            texts = ["" if t is None else t.encode(encoding, "replace").decode("latin-1") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [page, "line"])

    sorted_ = lines.repartition(page).sortWithinPartitions(page, *order).select(page, "line")
    bytes_ = sorted_.mapInArrow(recode, f"{page} {lines.schema[page].dataType.simpleString()}, line string")
    plain = {"encoding": "iso-8859-1", "sep": "\u0001", "quote": "", "escape": "\u0001", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    bytes_.write.mode("overwrite").options(**plain).partitionBy(page).csv(path)


def judged(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """page_id, announced, rows, ok of every page (page_id, and html or announced): whether it holds as many rows as it says.  ``rows`` are those
    ``bulletin`` found."""
    announced = F.col("announced") if "announced" in pages.columns else F.regexp_extract("html", r"(\d+) rows", 1).try_cast("long")
    said = pages.select("page_id", announced.alias("announced"))
    found = rows.filter("no IS NOT NULL").groupBy("page_id").agg(F.count("*").alias("rows"))
    out = said.join(found, "page_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.withColumn("ok", F.coalesce(F.col("announced") == F.col("rows"), F.lit(False)))
