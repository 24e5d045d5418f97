"""Corpus scans: which files belong to which collection, and their bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Folders never scanned.
SKIPPED_FOLDERS = [".git", "venv", "node_modules", "__pycache__"]
SKIPPED_PAIR = r"(^|/)\.claude/worktrees(/|$)"


def glob_regex(pattern: Column) -> Column:
    """Path glob as an anchored regular expression: ``**/`` any folders, ``*`` and ``?`` inside one part, ``[..]`` sets."""
    folders, anything = "\x01", "\x02"
    out = F.regexp_replace(pattern, r"([.^$+{}()|\\])", r"\\$1")
    steps = [("**/", folders), ("**", anything), ("*", "[^/]*"), ("[!", "[^"), (folders, "(?:.*/)?"), (anything, ".*")]
    out = F.replace(out, F.lit("?"), F.lit("[^/]"))
    for glob, regex in steps:
        out = F.replace(out, F.lit(glob), F.lit(regex))
    return F.concat(F.lit("^"), out, F.lit("$"))


def manifest_globs(spark: SparkSession, path: str) -> DataFrame:
    """Manifest JSON (one collection, or a list of them) to (collection, glob, regex)."""
    schema = "collection string, include array<string>, collections array<struct<name: string, include: array<string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return expand_manifest(raw)


def expand_manifest(raw: DataFrame) -> DataFrame:
    single = F.array(F.struct(F.col("collection").alias("name"), F.col("include").alias("include")))
    entries = raw.select(F.explode(F.coalesce("collections", single)).alias("e"))
    return entries.select(F.col("e.name").alias("collection"), F.explode("e.include").alias("glob")).withColumn(
        "regex", glob_regex(F.col("glob"))
    )


def manifest_problems(raw: DataFrame) -> DataFrame:
    """Rows that break the manifest rules: empty list, empty name, empty include."""
    single = F.array(F.struct(F.col("collection").alias("name"), F.col("include").alias("include")))
    empty = raw.filter(F.size("collections") == 0).select(F.lit(None).cast("string").alias("collection"),
                                                          F.lit("collections is empty").alias("problem"))
    entries = raw.select(F.explode(F.coalesce("collections", single)).alias("e")).select(
        F.col("e.name").alias("collection"), F.col("e.include").alias("include")
    )
    nameless = F.coalesce(F.col("collection") == "", F.lit(True))
    no_glob = F.coalesce(F.size("include") <= 0, F.lit(True))
    broken = entries.select(
        "collection",
        F.explode(F.array_compact(F.array(
            F.when(nameless, F.lit("collection name is empty")), F.when(no_glob, F.lit("include is empty"))
        ))).alias("problem"),
    )
    return empty.unionByName(broken)


def scan(spark: SparkSession, root: str, globs: DataFrame, hidden: list[str] = []) -> DataFrame:
    """(collection, document, bytes) of all markdown files below ``root`` that a glob of the manifest takes in.

    Spark's file listing passes over names that begin with ``.`` or ``_``. Folders of that kind that should be read are
    named in ``hidden``, relative to the root.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(
        [base, *[f"{base}/{h.strip('/')}" for h in hidden]])
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*(?=/)", "")
    prefix = F.lit(re.sub("^[a-z0-9]+:/*(?=/)", "", base) + "/")
    rel = F.substring(plain, F.length(prefix) + 1, F.length(plain))
    return select_files(files.select(rel.alias("document"), F.col("content").alias("bytes")), globs)


def select_files(files: DataFrame, globs: DataFrame) -> DataFrame:
    """Files (document = relative path) kept by the rules; a path that two globs take in counts once.

    The globs of one collection are joined into one expression, so a file is tested once per collection. The list of
    collections comes from a hand-written manifest.
    """
    kept = files.filter(F.col("document").endswith(".md") & ~F.col("document").rlike(SKIPPED_PAIR))
    for folder in SKIPPED_FOLDERS:
        kept = kept.filter(~F.array_contains(F.split("document", "/"), folder))
    per_collection = globs.groupBy("collection").agg(
        F.concat(F.lit("(?:"), F.array_join(F.array_sort(F.collect_set("regex")), ")|(?:"), F.lit(")")).alias("regex"))
    listed = per_collection.agg(F.collect_list(F.struct("collection", "regex")).alias("l")).select("l").scalar()
    offered = kept.withColumn("_taker", F.explode(listed))
    return offered.filter(F.rlike("document", "_taker.regex")).select(F.col("_taker.collection").alias("collection"), *files.columns)


def hashed(files: DataFrame) -> DataFrame:
    return files.select(
        "collection", "document", F.sha2("bytes", 256).alias("sha256"), F.col("bytes").cast("string").alias("content")
    )


def spread(df: DataFrame) -> DataFrame:
    """More tasks for a scan that yields fewer partitions than there are cores (one file, one row group).

    Meant for file scans in front of costly row work: a table with many splits passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
