"""The inverted index as tables: postings, document lengths and collection figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import index_tokens
from lodestar.session import written

DEFAULT_LENGTH = 1000.0


@dataclass
class Index:
    """``postings(term, doc_id, tf)`` and ``doc_len(doc_id, dl)``, the latter without documents that have no term.

    ``n_docs`` counts these, too. ``tokens(doc_id, terms)`` is kept of an index that isn't saved: a query then filters
    the terms of a document before they become rows.
    """

    postings: DataFrame
    doc_len: DataFrame
    n_docs: int
    total_len: int
    tokens: DataFrame | None = None

    @property
    def average(self) -> float:
        return self.total_len / self.n_docs if self.total_len else DEFAULT_LENGTH

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms in ``terms(term)``."""
        wanted = terms.select("term").distinct()
        if self.tokens is None:
            return self.postings.join(wanted, "term", "left_semi")
        rows = self.tokens.select("doc_id", F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
        return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))

    def term_df(self) -> DataFrame:
        """``(term, df)``."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def kept(self) -> Index:
        """The same index with its tables written to the checkpoint folder, compressed, for plans that use them many times."""
        postings = written(self.postings)
        # the lengths of an index that isn't saved would read all texts again
        doc_len = postings.groupBy("doc_id").agg(F.sum("tf").alias("dl")) if self.tokens is not None else self.doc_len
        return Index(postings, written(doc_len), self.n_docs, self.total_len)

    def resident(self) -> Index:
        """The same index with its tables in the executors' memory, postings by term, for many searches one after another."""
        postings, doc_len = self.postings.repartition("term").persist(), self.doc_len.persist()
        postings.count(), doc_len.count()
        return Index(postings, doc_len, self.n_docs, self.total_len)

    def save(self, path: str) -> None:
        """Write postings in ranges of terms, so that a reader skips most files of a term."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        self.doc_len.write.mode("overwrite").parquet(f"{path}/doc_len")
        figures = self.postings.sparkSession.createDataFrame([(self.n_docs, self.total_len)], "n_docs bigint, total_len bigint")
        figures.write.mode("overwrite").parquet(f"{path}/figures")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        figures = spark.read.parquet(f"{path}/figures").first()
        postings = spark.read.parquet(f"{path}/postings").select("term", "doc_id", "tf")
        return cls(postings, spark.read.parquet(f"{path}/doc_len").select("doc_id", "dl"), figures.n_docs, figures.total_len)


def token_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, terms)``: the terms of each document in order, without the stopwords of the index; NULL texts have none."""
    return docs.select("doc_id", F.coalesce(index_tokens(F.col("text")), F.array().cast("array<string>")).alias("terms"))


def postings_of(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf")


def build(docs: DataFrame) -> Index:
    """Index of ``docs(doc_id, text)``, whose ids must differ. Its figures are counted at once, its tables when used."""
    tokens = token_table(docs)
    figures = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("total")).first()
    doc_len = tokens.select("doc_id", F.size("terms").cast("bigint").alias("dl")).where("dl > 0")
    return Index(postings_of(tokens), doc_len, figures.n, figures.total, tokens)


def extend(index_path: str, docs: DataFrame, batch: str) -> Index:
    """Add the documents of ``docs`` that a saved index hasn't processed; documents it has are not read again.

    Everything a batch adds lies in folders of its name, which are overwritten, so a batch may be repeated after a
    failure at any point.
    """
    spark = docs.sparkSession
    processed = spark.read.schema("doc_id string, batch string").parquet(f"{index_path}/processed").where(F.col("batch") != batch)
    fresh = token_table(docs.join(processed, "doc_id", "left_anti")).persist()
    try:
        postings_of(fresh).write.mode("overwrite").parquet(f"{index_path}/postings/batch={batch}")
        fresh.select("doc_id", F.size("terms").cast("bigint").alias("dl")).where("dl > 0").write.mode("overwrite").parquet(f"{index_path}/doc_len/batch={batch}")
        fresh.select("doc_id").write.mode("overwrite").parquet(f"{index_path}/processed/batch={batch}")
    finally:
        fresh.unpersist()
    return refresh(spark, index_path)


def start(spark: SparkSession, index_path: str) -> None:
    """An empty index that ``extend`` and the stream add to."""
    spark.createDataFrame([], "doc_id string").write.mode("overwrite").parquet(f"{index_path}/processed/batch=start")
    spark.createDataFrame([], "term string, doc_id string, tf bigint").write.mode("overwrite").parquet(f"{index_path}/postings/batch=start")
    spark.createDataFrame([], "doc_id string, dl bigint").write.mode("overwrite").parquet(f"{index_path}/doc_len/batch=start")
    refresh(spark, index_path)


def refresh(spark: SparkSession, index_path: str) -> Index:
    """Count the figures of a grown index anew and load it."""
    n = spark.read.parquet(f"{index_path}/processed").count()
    doc_len = spark.read.parquet(f"{index_path}/doc_len")
    total = doc_len.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    spark.createDataFrame([(n, total)], "n_docs bigint, total_len bigint").write.mode("overwrite").parquet(f"{index_path}/figures")
    return Index.load(spark, index_path)
