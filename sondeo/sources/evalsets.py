"""Evaluation inputs: query sets, judgments, segmentation artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EXPECTED = "struct<document: string, chunk_index: int, identifying_quote: string>"
QUERY = f"struct<query: string, type: string, expected_documents: array<string>, expected_chunks: array<{EXPECTED}>>"
SPAN = "struct<line_start: int, line_end: int>"
PASS_A = (
    "document string, model string, blocks array<struct<id: string, line_start: int, line_end: int, subject: string>>, "
    "trash array<struct<line_start: int, line_end: int, type: string>>"
)
PASS_B = (
    f"document string, model string, themes array<struct<id: string, label: string, need: string, spans: array<{SPAN}>, "
    "soft_members: array<struct<block: string, also_in: array<string>>>, distributed_justification: string>>, "
    f"resplits array<struct<pass_a_block: string, new_spans: array<{SPAN}>, reason: string>>, "
    "unassigned array<struct<block: string, reason: string>>"
)
PASS_C = (
    "document string, model string, summaries array<struct<theme_id: string, field: string, information_need: string, "
    "primary_concept: string, sub_concepts: array<string>, answer_type: string>>"
)
PASS_D = "document string, model string, queries array<struct<theme_id: string, format: string, query: string>>"


def read_query_sets(spark: SparkSession, path: str) -> DataFrame:
    return parse_query_sets(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"))


def parse_query_sets(files: DataFrame) -> DataFrame:
    """One row per file with the query array, whether the file is an object with ``queries`` or a bare array."""
    body = F.trim("value")
    bare = F.from_json(body, f"array<{QUERY}>")
    wrapped = F.from_json(body, f"struct<queries: array<{QUERY}>>")["queries"]
    return files.select("file", F.when(body.startswith("["), bare).otherwise(wrapped).alias("queries"))


def query_table(sets: DataFrame) -> DataFrame:
    return sets.select("file", F.posexplode("queries").alias("pos", "q")).select(
        F.concat_ws("#", "file", (F.col("pos") + 1).cast("string")).alias("query_id"), "q.*"
    )


def expected_chunks(queries: DataFrame) -> DataFrame:
    """Expected chunks in list order; duplicates stay, as recall counts them."""
    return queries.select("query_id", F.posexplode("expected_chunks").alias("pos", "e")).select("query_id", "pos", "e.*")


def expected_documents(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("expected_documents").alias("document"))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value",
    )
    return latest_judgments(judgment_rows(lines))


def judgment_rows(lines: DataFrame) -> DataFrame:
    """``id grade [a1,a2]`` lines; comments and short lines drop out."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    kept = lines.withColumn("p", parts).filter((F.size("p") >= 2) & ~F.col("p")[0].startswith("#"))
    aspects = F.when(F.size("p") > 2, F.array_distinct(F.split(F.col("p")[2], ","))).otherwise(F.array().cast("array<string>"))
    return kept.select("file", "block", "line", F.col("p")[0].alias("id"), F.col("p")[1].cast("int").alias("grade"),
                       F.array_sort(aspects).alias("aspects"))


def latest_judgments(rows: DataFrame) -> DataFrame:
    """The last line of the last file by name wins for an id."""
    return rows.groupBy("id").agg(
        F.max_by(F.struct("grade", "aspects"), F.struct("file", "block", "line")).alias("j")
    ).select("id", "j.grade", "j.aspects")


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def blocks(pass_a: DataFrame) -> DataFrame:
    return pass_a.select("document", F.explode("blocks").alias("b")).select("document", "b.*")


def trash(pass_a: DataFrame) -> DataFrame:
    return pass_a.select("document", F.posexplode("trash").alias("pos", "t")).select("document", "pos", "t.*")


def themes(pass_b: DataFrame) -> DataFrame:
    return pass_b.select("document", F.explode("themes").alias("t")).select("document", "t.*")


def theme_spans(themes_df: DataFrame) -> DataFrame:
    return themes_df.select("document", F.col("id").alias("theme_id"), F.explode("spans").alias("s")).select(
        "document", "theme_id", "s.*"
    )


def spans_only(themes_df: DataFrame) -> DataFrame:
    """What the next author may see: document, theme id and spans, nothing else."""
    out = themes_df.select("document", "id", "spans")
    allowed = {"document", "id", "spans"}
    extra = set(out.columns) - allowed | set(out.schema["spans"].dataType.elementType.names) - {"line_start", "line_end"}
    if extra:
        raise ValueError(f"columns outside the allowed set: {sorted(extra)}")
    return out


def summaries(pass_c: DataFrame) -> DataFrame:
    return pass_c.select("document", F.explode("summaries").alias("s")).select("document", "s.*")


def authored_queries(pass_d: DataFrame) -> DataFrame:
    return pass_d.select("document", F.explode("queries").alias("q")).select("document", "q.*")
