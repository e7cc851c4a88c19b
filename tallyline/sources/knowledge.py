"""Knowledge-base files: markdown documents with frontmatter, prior resolutions, and the corpus digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.text import strip

FRONTMATTER = r"(?s)^---\n(.*?)\n---\n(.*)$"
# The keys a document carries; `challenges` labels a test and must not reach retrieval.
META = ["doc_id", "title", "doc_type", "version", "effective_date", "status", "access_level", "plant", "supersedes",
        "superseded_by", "audience"]


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files as (file_name, value), one row per file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(
        F.col("_metadata.file_name").alias("file_name"), "value")


def documents(files: DataFrame) -> DataFrame:
    """Files (file_name, value) as frontmatter columns and body. A NULL doc_id marks a file without frontmatter."""
    raw = files.select("file_name", F.regexp_replace("value", "\r\n", "\n").alias("value"))
    lines = F.split(F.regexp_extract("value", FRONTMATTER, 1), "\n")
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(
        strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    meta = raw.select("file_name", F.map_from_entries(pairs).alias("m"),
                      F.regexp_extract("value", FRONTMATTER, 2).alias("body"))
    blank = lambda c: F.when(~c.isin("", "None", "null"), c)
    return meta.select("file_name", *[blank(F.try_element_at("m", F.lit(k))).alias(k) for k in META], "body")


def resolutions(spark: SparkSession, path: str) -> DataFrame:
    """One chunk per prior resolution."""
    r = spark.read.json(path, multiLine=True)
    rule, kind = F.substring_index("rule_id", "_", 1), F.regexp_replace(F.regexp_replace("rule_id", "^[^_]*_?", ""), "_", " ")
    text = F.concat(
        F.lit("Prior resolution "), "resolution_id", F.lit(" ("), "plant", F.lit(", rule "), rule, F.lit(": "), kind,
        F.lit(")\n\nPattern: "), "pattern", F.lit("\nClassification: "), "classification", F.lit("\nResolution: "),
        "resolution", F.lit("\nResolved by "), "resolved_by", F.lit(" on "), "resolved_on", F.lit("."))
    return r.select(F.concat("resolution_id", F.lit("#0")).alias("chunk_id"), F.col("resolution_id").alias("doc_id"),
                    text.alias("text"), F.lit("prior_resolution").alias("doc_type"), "plant", "rule_id")


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """Chunk ids that occur more than once; a corpus with any is refused."""
    return chunks.groupBy("chunk_id").count().where("count > 1")


LEVELS = (5, 3, 1)  # leading hexadecimal digits of the nodes of each level


def _node(rows: DataFrame, depth: int, of: Column, what: Column) -> DataFrame:
    return rows.groupBy(F.left(of, F.lit(depth)).alias("node")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(what)), ""), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def buckets(files: DataFrame) -> DataFrame:
    """The lowest nodes of the corpus digest (node, digest, n) from (path, text_sha256): documents by the first digits of a
    digest of their own. An index keeps this table, at most 16^5 rows, to tell later which of its documents are stale."""
    leaf = F.sha2(F.concat(F.coalesce("path", F.lit("")), F.lit(":"), F.coalesce("text_sha256", F.lit(""))), 256)
    return _node(files.select(leaf.alias("leaf")), LEVELS[0], F.col("leaf"), F.col("leaf"))


def corpus_digest(files: DataFrame) -> DataFrame:
    """One digest of the whole corpus from (path, text_sha256), and its size. It is the root of a tree whose nodes are digests of
    their children in order; no node has more than 256 children above the buckets, so no list of all documents is formed."""
    level = buckets(files)
    size = level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    for depth in (*LEVELS[1:], 0):
        level = _node(level, depth, F.col("node"), F.concat("node", "digest"))
    root = F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256))
    return level.agg(root.alias("corpus_sha256")).crossJoin(F.broadcast(size))  # one row each


def stale_buckets(held: DataFrame, files: DataFrame) -> DataFrame:
    """The nodes in which an index built over `held` buckets and the corpus of today differ; none if it is up to date."""
    now = buckets(files)
    return held.select("node", F.col("digest").alias("_held")).join(now.select("node", F.col("digest").alias("_now")), "node", "full").where(
        ~F.col("_held").eqNullSafe(F.col("_now"))).select("node")
