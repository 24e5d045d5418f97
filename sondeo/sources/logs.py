"""Search, expand, error and configuration logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sondeo.functions import logs

HIT = "struct<rank: int, document: string, chunk_index: int, score: double>"
SEARCH_LOG = (
    "ts string, search_id string, code_version string, query string, collection string, document string, "
    f"exclude string, candidates int, duration_ms int, hit_count int, config_fingerprint string, hits array<{HIT}>"
)
SEARCH_CONTENT = "search_id string, rank int, document string, chunk_index int, content string"
EXPAND_LOG = (
    "ts string, expand_id string, code_version string, collection string, document string, chunk_index int, "
    "before int, after int, chunks_returned int, duration_ms int"
)
MODEL = "preset: string, model_name: string, model_path: string, quantization: string, context_size: int"
REGISTRY = (
    f"fingerprint string, first_seen string, embedding struct<{MODEL}, vector_dimension: int>, query_prefix string, "
    f"truncation_limit_tokens int, reranker struct<{MODEL}, instruction: string>, candidate_count_requested int"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines do not count and a missing file is an empty table."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.globStatus(target):
        return spark.createDataFrame([], schema)
    return parse_lines(spark.read.text(path), schema)


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Records of JSON lines. A line that is no JSON stops the read, as a half-written log must not count as records."""
    return sound(lines).select(F.from_json("value", schema).alias("r")).select("r.*")


def sound(lines: DataFrame) -> DataFrame:
    """Lines that are not blank, each checked to be JSON when it is read."""
    broken = F.raise_error(F.concat(F.lit("not a JSON line: "), F.left("value", F.lit(200))))
    return lines.filter(F.trim("value") != "").select(F.when(F.try_parse_json("value").isNull(), broken.cast("string")).otherwise(F.col("value")).alias("value"))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """ts, server, code, msg and every further key as text in ``extra``."""
    fixed = ["ts", "server", "code", "msg"]
    parsed = sound(spark.read.text(path)).select(F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select(
        *[F.col("m")[k].alias(k) for k in fixed], F.map_filter("m", lambda k, v: ~k.isin(fixed)).alias("extra")
    )


def with_time(log: DataFrame) -> DataFrame:
    return log.withColumn("ts", logs.parse_utc(F.col("ts")))


def search_records(searches: DataFrame, hits: DataFrame) -> DataFrame:
    """Search rows with their hits nested in rank order; a search without hits keeps an empty list.

    A list holds at most the depth of its search, so the nested array is short.
    """
    nested = hits.groupBy("search_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "document", "chunk_index", "score"))).alias("hits")
    )
    empty = F.array().cast(f"array<{HIT}>")
    joined = searches.join(nested, "search_id", "left").withColumn("hits", F.coalesce(F.col("hits").cast(f"array<{HIT}>"), empty))
    return joined.withColumn("hit_count", F.size("hits"))


def search_content(hits: DataFrame) -> DataFrame:
    return hits.select("search_id", "rank", "document", "chunk_index", "content")


def append_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def expand_records(expansions: DataFrame) -> DataFrame:
    return expansions.select(
        "ts", "expand_id", "code_version", "collection", "document", "chunk_index", "before", "after",
        "chunks_returned", "duration_ms",
    )


def expand_content(expansions: DataFrame) -> DataFrame:
    return expansions.select("expand_id", "collection", "document", "chunk_index", "content")


def new_configurations(snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    """First-seen snapshot of every fingerprint that the registry lacks."""
    fresh = snapshots.join(registry.select("fingerprint").distinct(), "fingerprint", "left_anti")
    rest = [c for c in snapshots.columns if c != "fingerprint"]
    return fresh.groupBy("fingerprint").agg(F.min_by(F.struct(*rest), "first_seen").alias("s")).select("fingerprint", "s.*")
