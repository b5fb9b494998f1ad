"""Readers and writers of the crawl's files, and the same shapes from given tables."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import normalise_url, strip

URL_MAP = "id LONG, url STRING"
EDGES = "src STRING, dst STRING"
COMPETITORS = "MAP<STRING, ARRAY<STRUCT<engine: STRING, title: STRING, url: STRING, snippet: STRING>>>"


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)`` of all text files below a folder, the file's name being the id; bytes that aren't UTF-8, and replacement
    characters, are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    read = files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), text.alias("text"))
    # Spark passes over files of no bytes; its own listing, which the driver holds anyway for every file it reads, has them
    listed = spark.createDataFrame([(unquote(p.rsplit("/", 1)[-1]),) for p in files.inputFiles()], "doc_id string")
    return listed.join(read, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def write_pages(docs: DataFrame, folder: str) -> None:
    """One text file per row of ``docs(doc_id, text)``, named by its id, in a folder that all executors reach; a NULL text is an empty file."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write((text or "").encode("utf-8", "replace"))
            yield batch.select([0]).slice(0, 0)

    docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(put, "doc_id string").write.format("noop").mode("overwrite").save()


def page_id(n: Column) -> Column:
    return F.concat(F.lit("page_"), n.cast("string"), F.lit(".txt"))


def read_url_map(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, url)`` of a JSON-lines mapping; a missing file is an empty mapping, rows without id or url are left out."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    rows = spark.read.schema(URL_MAP).json(path) if there else spark.createDataFrame([], URL_MAP)
    return url_map(rows)


def url_map(rows: DataFrame) -> DataFrame:
    """``(doc_id, url)`` from rows of id and url: URLs trimmed, the least URL where an id has several."""
    return rows.where("id IS NOT NULL AND url IS NOT NULL").groupBy(page_id(F.col("id")).alias("doc_id")).agg(F.min(strip(F.col("url"))).alias("url"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst)`` of a JSON-lines graph, repeated links kept; lines that aren't such an object are left out."""
    return spark.read.schema(EDGES).option("mode", "DROPMALFORMED").json(path).where("src IS NOT NULL AND dst IS NOT NULL")


def edges(rows: DataFrame) -> DataFrame:
    """``(src, dst)`` of a link table: all links between two known ends, repeated ones too."""
    return rows.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")


def link_scores(scores: DataFrame) -> DataFrame:
    """``(url_key, page_rank)``: scores by normalised URL, the largest where several URLs fall together."""
    return scores.groupBy(normalise_url(F.col("url")).alias("url_key")).agg(F.max("pagerank").alias("page_rank"))


def documents(pages: DataFrame) -> DataFrame:
    """``(doc_id, text)``: one row per doc_id, the latest, then the one of the greatest text; NULL ids are left out.

    Copies of one id are reduced before the shuffle, so no task meets all of them.
    """
    return pages.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max_by("text", F.struct("fetched_at", "text")).alias("text"))


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, section, query_text)`` of a file with headed sections of numbered queries.

    A header that names neither section doesn't change it; ids count the queries from 1. A query set is written by
    hand, so its lines are numbered in one task.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    header = F.when(~F.col("line").rlike("^\\s*[0-9]"), F.when(F.lower("line").contains("rocchio"), "rocchio").when(F.lower("line").contains("cluster"), "cluster"))
    order = Window.partitionBy(F.lit(1)).orderBy("n")
    named = lines.withColumn("section", F.last(header, ignorenulls=True).over(order)).where(F.col("line").rlike("^\\s*[0-9]+\\. "))
    return named.select(F.row_number().over(order).cast("bigint").alias("query_id"), "section", strip(F.regexp_extract("line", "^\\s*[0-9]+\\. (.*)$", 1)).alias("query_text"))


def read_competitors(spark: SparkSession, path: str) -> DataFrame:
    """``(query, engine, title, url, snippet)`` of a JSON object of hit lists by query."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", COMPETITORS).alias("m"))
    return raw.select(F.explode("m").alias("query", "hits")).select("query", F.inline("hits"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_crawl_state(visited: DataFrame, frontier: DataFrame, path: str, most: int | None = None) -> None:
    """Save visited and frontier URLs, ``(url)`` each, as JSON lines; of the frontier all, or the first ``most`` in order of URL."""
    visited.select("url").write.mode("overwrite").json(f"{path}/visited")
    (frontier if most is None else frontier.orderBy("url").limit(most)).select("url").write.mode("overwrite").json(f"{path}/frontier")


def read_crawl_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Visited and frontier URLs of a saved crawl."""
    return tuple(spark.read.schema("url STRING").json(f"{path}/{part}") for part in ("visited", "frontier"))


def save_link_scores(scores: DataFrame, path: str) -> None:
    """Save ``(url, pagerank, hub, authority)``."""
    scores.select("url", "pagerank", "hub", "authority").write.mode("overwrite").parquet(path)


def read_link_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url STRING, pagerank DOUBLE, hub DOUBLE, authority DOUBLE").parquet(path)
