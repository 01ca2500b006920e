"""Readers of documents, ledgers, backups, sheets and question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

EXTENSIONS = ("txt", "docx", "pdf", "md")
_PATHS = "path string, hash string"


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, kind, size, modified, content, hash, error) of the files under a folder with these suffixes.

    A file that is listed but can't be read is a row without content and with
    an error. Listing reads no contents, so such files are those that are
    missing among the ones read.
    """
    glob = "*.{" + ",".join(extensions) + "}"

    def found(skip: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", skip).load(folder)

    facts = ["path", t.file_kind(F.col("path")).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    good = found("true").where("content is not null").select(*facts, "content", F.md5("content").alias("hash"), F.lit(None).cast("string").alias("error"))
    listed = found("false").select(*facts)
    readable = good.where("hash is not null").select("path")
    bad = listed.join(readable, "path", "left_anti").select("path", "kind", "size", "modified", F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("hash"), F.lit("unreadable").alias("error"))
    return good.unionByName(bad)


def text_documents(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("txt", "md")) -> DataFrame:
    """(path, file_name, text, hash) of text files, one row each; text that is no UTF-8 has its bad bytes replaced."""
    f = files(spark, folder, extensions)
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "hash")


def allowed(kind: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return F.coalesce(kind.isin(*extensions), F.lit(False))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of files already taken in; empty if there is no ledger yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], _PATHS)
    return spark.read.schema(_PATHS).json(path)


def ledger_of_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash) of a ledger written as one JSON object."""
    whole = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string,string>")
    return whole.select(F.explode(pairs).alias("path", "hash"))


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path and content the ledger doesn't have."""
    return found.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def backup(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, reason) of deleted nodes, from a JSON array or from lines."""
    return spark.read.schema("id string, name string, reason string").option("multiLine", "true").json(path)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as comma-separated text with a header; all columns are strings."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)


def literal_graph(spark: SparkSession, nodes: list[tuple[str, str]], edges: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of values; nodes that only edges name are made."""
    named = spark.createDataFrame(nodes, "name string, type string")
    linked = spark.createDataFrame(edges, "src string, rel string, dst string").distinct()
    ends = linked.select(F.explode(F.array("src", "dst")).alias("name")).distinct().join(named, "name", "left_anti")
    return named.dropDuplicates(["name"]).unionByName(ends.withColumn("type", F.lit("Entity"))), linked


def questions(df: DataFrame, text: str = "value") -> DataFrame:
    """(number, question, context, answer) of numbered blocks ``n. 问题：… 上下文：… 正确答案：…``."""
    block = r"(?s)(\d+)[.、]\s*问题[:：]\s*(.*?)\s*上下文[:：]\s*(.*?)\s*正确答案[:：]\s*(.*?)(?=\n\s*\d+[.、]\s*问题|\z)"
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit(block), 0)).alias("b"))
    return found.select(F.regexp_extract("b", block, 1).cast("int").alias("number"), *[F.trim(F.regexp_extract("b", block, i)).alias(n) for i, n in ((2, "question"), (3, "context"), (4, "answer"))])
