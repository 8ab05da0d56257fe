"""File sources and sinks: bucket documents, manifests, native dialogues, fingerprints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.graph import NODE
from foliant.schemas import MEGAFILE
from foliant.session import ensure_checkpoint_dir

# Landed-page sources by name; each yields the raw page contract.
SOURCES: dict = {}


def register_source(name: str):
    """Register a function ``(spark, path) → DataFrame`` with the raw page columns."""
    def add(fn):
        SOURCES[name] = fn
        return fn
    return add


def load_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    from foliant.schemas import RAW_PAGE
    return SOURCES[name](spark, path).select(*RAW_PAGE.names)


@register_source("parquet")
def parquet_source(spark, path):
    return spark.read.parquet(path)


@register_source("json")
def json_source(spark, path):
    from foliant.schemas import RAW_PAGE
    return spark.read.schema(RAW_PAGE).json(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, shared by all executors."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_megafiles(documents: DataFrame, path: str) -> None:
    """One JSON document per line and bucket folder; the commit protocol publishes whole
    files only."""
    documents.select("bucket_id", F.col("document").alias("value")).write.mode(
        "overwrite").partitionBy("bucket_id").text(path)


def read_megafiles(spark: SparkSession, path: str) -> DataFrame:
    """Pages of bucket documents with the bucket they came from."""
    docs = spark.read.text(path).select(
        "bucket_id", F.from_json("value", MEGAFILE).alias("d"))
    # The folder names the bucket; a page's own bucket_id field is the same by construction.
    return docs.select("bucket_id", F.explode("d.pages").alias("p")).select(
        F.col("bucket_id").alias("bucket"), "p.*")


def read_manifests(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Entities of localized manifests: ``{"Export<Cat>": [...]}`` or a bare list.

    The language is the folder name (``lang=xx``).  Entries without a unique name drop out;
    documents of another shape yield nothing (see :func:`rejected_manifests`).
    """
    docs = spark.read.text(path, wholetext=True)
    entry = ("array<struct<uniqueName:string,name:string,description:string>>")
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.col("value")).otherwise(
        F.get_json_object("value", f"$.{category}"))
    rows = docs.select("lang", F.explode(F.from_json(listed, entry)).alias("e"))
    return rows.filter("e.uniqueName IS NOT NULL AND e.uniqueName <> ''").select(
        F.col("e.uniqueName").alias("entity_id"), F.lit(category).alias("entity_type"), "lang",
        F.col("e.name").alias("name"), F.col("e.description").alias("description"))


def rejected_manifests(spark: SparkSession, path: str, category: str) -> DataFrame:
    """Documents that are neither a list nor hold the category's list."""
    docs = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    ok = F.startswith(F.ltrim("value"), F.lit("[")) | F.startswith(
        F.ltrim(F.get_json_object("value", f"$.{category}")), F.lit("["))
    return docs.filter(~F.coalesce(ok, F.lit(False))).select("file", "lang")


def read_manifest_index(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """Index lines ``name!00_digest`` of the configured categories."""
    lines = spark.read.text(path)
    name, digest = (F.substring_index("value", "!00_", 1),
                    F.regexp_extract("value", r"!00_(.+)$", 1))
    return lines.select(name.alias("name"), F.trim(digest).alias("digest"), F.substring_index(
        name, "_", 1).alias("category")).filter(
        (F.col("name") != "") & (F.col("digest") != "") & F.col("category").isin(*categories))


def read_dialogue_files(spark: SparkSession, path: str) -> DataFrame:
    """Native dialogue files, one JSON node array per line: (file, nodes)."""
    rows = spark.read.text(path)
    return rows.select(F.get_json_object("value", "$.file").alias("file"), F.from_json(
        F.get_json_object("value", "$.nodes"), f"array<{NODE}>").alias("nodes"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Path, modification time and size of each file (content is not read)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.regexp_replace("path", r"^.*/", "").alias("file"),
        F.unix_micros("modificationTime").alias("modified"), "length")


def folder_fingerprints(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Fingerprint of each ``column=…`` folder: its newest modification time and its size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.groupBy(F.regexp_extract("path", rf"{column}=([^/]+)/", 1).alias("file")).agg(
        F.max(F.unix_micros("modificationTime")).alias("modified"),
        F.sum("length").alias("length"))


def drop_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def file_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Files to read again, to drop, and to leave, by fingerprint."""
    s = stored.select("file", F.struct("modified", "length").alias("s"))
    c = current.select("file", F.struct("modified", "length").alias("c"))
    return s.join(c, "file", "full_outer").select("file", F.when(
        F.col("s").isNull(), "added").when(F.col("c").isNull(), "removed").when(
        F.col("s") == F.col("c"), "unchanged").otherwise("changed").alias("change"))
