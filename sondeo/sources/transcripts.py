"""Agent transcripts: JSON lines whose message content is a text or a list of blocks."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sondeo.functions import ordered, text

# Tool names, value flags, words and signs that may stand before a command, read-back marker.
SHELL_TOOL = "Bash"
READ_TOOL = "Read"
VALUE_FLAGS = ("--document", "--exclude")
LEADING_WORDS = ("do", "then", "exec", "time")
OPERATORS = ";&|<>()"
READBACK_MARKER = "/tool-results/"
CONTEXT_CHARS = 1500

ARGUMENTS = "array<struct<query: string, collection: string, document: string, exclude: string>>"
SPLIT_STEP = 2**20  # scan splits are at least this large
ROW_BITS = 33       # bits of the row number inside a partition


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_order, value). The order is (start of the scan split, row inside it), packed into one long."""
    start = F.floor(F.col("_metadata.file_block_start") / SPLIT_STEP)
    row = F.monotonically_increasing_id().bitwiseAND(2**ROW_BITS - 1)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), (start * 2**ROW_BITS + row).alias("line_order"), "value"
    )


def messages(lines: DataFrame) -> DataFrame:
    """Parsed records; lines that are no JSON drop out. ``blocks`` is null where the content is plain text."""
    record = F.try_parse_json("value")
    parsed = lines.withColumn("r", record).filter(F.col("r").isNotNull())

    def at(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("r", path, kind)

    return parsed.select(
        "file", "line_order", at("$.timestamp").alias("timestamp"), at("$.sessionId").alias("session_id"),
        at("$.cwd").alias("cwd"), at("$.message.role").alias("role"),
        F.when(F.schema_of_variant(F.try_variant_get("r", "$.message.content", "variant")) == "STRING",
               at("$.message.content")).alias("text_content"),
        F.try_variant_get("r", "$.message.content", "array<variant>").alias("blocks"),
    )


def _field(path: str) -> Column:
    return F.try_variant_get("b", path, "string")


def exploded_blocks(msgs: DataFrame) -> DataFrame:
    return msgs.select("file", "line_order", "timestamp", "session_id", "cwd", "role",
                       F.posexplode("blocks").alias("pos", "b"))


def _searches_in(command: str, tool: str) -> list[dict]:
    """Argument sets of every ``tool search …`` command inside a shell line."""
    separated = re.sub(r"'[^']*'|\"(?:\\.|[^\"\\])*\"|\n", lambda m: " ; " if m[0] == "\n" else m[0], command, flags=re.S)
    lexer = shlex.shlex(separated, posix=True, punctuation_chars=True)
    lexer.whitespace_split = True
    try:
        tokens = list(lexer)
    except ValueError:  # unbalanced quotes
        return []
    segments: list[list[str]] = [[]]
    for token in tokens:
        if all(sign in OPERATORS for sign in token):
            segments.append([])
        else:
            segments[-1].append(token)
    found = []
    for segment in segments:
        for i in range(len(segment) - 1):
            named = segment[i].rsplit("/", 1)[-1] == tool and segment[i + 1] == "search"
            if named and (i == 0 or segment[i - 1] in LEADING_WORDS):
                found.append(_arguments(segment[i + 2:]))
                break
    return found


def _arguments(tokens: list[str]) -> dict:
    """The words after the command: a value flag owns the word behind it, other flags are switches, the first two plain words count."""
    found: dict = dict.fromkeys(("query", "collection", "document", "exclude"))
    owner = None
    for token in tokens:
        if owner is not None:
            found[owner], owner = token, None
        elif token in VALUE_FLAGS:
            owner = token.removeprefix("--")
        elif not token.startswith("--"):
            free = [name for name in ("query", "collection") if found[name] is None]
            found |= {name: token for name in free[:1]}
    return found


def search_arguments(command: Column, tool: str) -> Column:
    """Shell grammar is beyond column expressions; one Arrow batch function over the matching commands only."""

    @F.pandas_udf(ARGUMENTS)
    def parse(commands: pd.Series) -> pd.Series:
        return commands.map(lambda c: _searches_in(c, tool) if c else [])

    return parse(command)


def tool_calls(lines: DataFrame, tool: str) -> DataFrame:
    """One row per search inside a command, paired with the result of the command by its id within the file."""
    marked = lines.filter(F.col("value").contains(tool) | F.col("value").contains("tool_use_id"))
    blocks = exploded_blocks(messages(marked))
    uses = blocks.filter((_field("$.type") == "tool_use") & (_field("$.name") == SHELL_TOOL)).select(
        "file", "line_order", "pos", _field("$.id").alias("tool_use_id"), "session_id", "cwd",
        F.col("timestamp").alias("tool_use_ts"), _field("$.input.command").alias("command"),
    ).filter(F.col("command").contains(tool))
    calls = uses.select(
        "file", "tool_use_id", "session_id", "cwd", "tool_use_ts", "line_order", "pos",
        F.posexplode(search_arguments(F.col("command"), tool)).alias("search_pos", "a"),
    ).select("*", "a.*").drop("a")
    parts = F.try_variant_get("b", "$.content", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), " ")
    plain = F.when(F.schema_of_variant(F.try_variant_get("b", "$.content", "variant")) == "STRING", _field("$.content"))
    results = blocks.filter(_field("$.type") == "tool_result").select(
        "file", _field("$.tool_use_id").alias("tool_use_id"), F.col("timestamp").alias("result_ts"),
        F.coalesce(plain, joined, F.lit("")).alias("result_text"), F.col("line_order").alias("_order"),
    )
    last = results.groupBy("file", "tool_use_id").agg(
        F.max_by(F.struct("result_ts", "result_text"), "_order").alias("res")
    )
    return calls.join(last, ["file", "tool_use_id"], "left").select(
        *[c for c in calls.columns], F.col("res.result_ts").alias("result_ts"),
        F.coalesce("res.result_text", F.lit("")).alias("result_text"),
    )


def readbacks(lines: DataFrame) -> DataFrame:
    """Commands and file reads that open a saved tool output."""
    blocks = exploded_blocks(messages(lines.filter(F.col("value").contains(READBACK_MARKER))))
    shell = _field("$.name") == SHELL_TOOL
    body = F.when(shell, _field("$.input.command")).otherwise(_field("$.input.file_path"))
    return blocks.filter((_field("$.type") == "tool_use") & _field("$.name").isin(SHELL_TOOL, READ_TOOL)).select(
        "session_id", F.col("timestamp").alias("ts"), body.alias("text")
    ).filter(F.col("text").contains(READBACK_MARKER))


def context_calls(lines: DataFrame, marker: str) -> DataFrame:
    """Each shell call holding ``marker`` with the last user and assistant text up to its own message."""
    msgs = messages(lines.filter(F.col("value").contains('"message"')))
    kept = msgs.filter(F.col("role").isin("user", "assistant"))
    texts = F.transform(
        F.filter("blocks", lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")),
    )
    spoken = kept.select(
        "file", "line_order", "role",
        text.strip_ws(F.coalesce("text_content", F.array_join(texts, "\n"), F.lit(""))).alias("spoken"),
    ).filter(F.col("spoken") != "")
    calls = exploded_blocks(kept.filter(F.col("role") == "assistant")).filter(
        (_field("$.type") == "tool_use") & (_field("$.name") == SHELL_TOOL)
    ).select("file", "line_order", "pos", "timestamp", _field("$.input.command").alias("command")).filter(
        F.col("command").contains(marker)
    )
    return with_context(calls, spoken)


def with_context(calls: DataFrame, spoken: DataFrame, width: int = 2**ROW_BITS) -> DataFrame:
    """Last user and assistant text at or before each call's line, cut to the closing characters."""
    out = calls
    for role in ("user", "assistant"):
        said = spoken.filter(F.col("role") == role)
        out = ordered.largest_before(
            out, said, ["file"], "line_order", "line_order", F.struct("line_order", "spoken"), width, f"_{role}"
        )
        out = out.withColumn(
            f"{role}_text", F.coalesce(F.right(F.col(f"_{role}.spoken"), F.lit(CONTEXT_CHARS)), F.lit(""))
        ).drop(f"_{role}")
    return out
