"""Column expressions over search logs, command results, collections and configurations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Labels and patterns of the log records.
UNVERSIONED = "unversioned"
DOCS_SUFFIX = "-docs"
REFERENCE_SUFFIX = "-reference"
HOOK_MARKER = "hook error"
HOOK_PATTERN = r"hook error: \[[^\]]*?([^/\s\]]+)\]: ([^\n]*)"
PERSISTED_PREFIX = "<persisted-output>"
PERSISTED_PATH = r"Full output saved to: (\S+)"
PERSISTED_SIZE = r"Output too large \(([\d.]+)KB\)"
QUANTIZATION = r"(?i)(Q\d[A-Z0-9_]*|BF16|F16|F32)\z"


def version_or_default(version: Column) -> Column:
    return F.coalesce(F.nullif(version, F.lit("")), F.lit(UNVERSIONED))


def parse_utc(text: Column) -> Column:
    """ISO text to a timestamp; ``Z`` and offsets are honoured, a bare time counts as UTC (session zone UTC)."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("+00:00"))))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def reference_owner(collection: Column) -> Column:
    return F.when(
        collection.endswith(REFERENCE_SUFFIX), F.left(collection, F.length(collection) - len(REFERENCE_SUFFIX))
    )


def reference_relation(collection: Column, project: Column) -> Column:
    owner = reference_owner(collection)
    return (
        F.when(owner.isNull(), F.lit(None).cast("string"))
        .when(project.isNull(), F.lit("unknown_project"))
        .when(owner == project, F.lit("own"))
        .otherwise(F.lit("foreign"))
    )


def stratum(collection: Column) -> Column:
    return (
        F.when(collection.endswith(REFERENCE_SUFFIX), "reference")
        .when(collection.endswith(DOCS_SUFFIX), "docs")
        .otherwise("other")
    )


def path_parts_before_tooling(cwd: Column) -> Column:
    """Path parts up to the first ``.claude`` part."""
    parts = F.split(cwd, "/")
    at = F.array_position(parts, ".claude")
    return F.when(at > 0, F.slice(parts, F.lit(1), (at - 1).cast("int"))).otherwise(parts)


def command_state(text: Column) -> Column:
    return (
        F.when(F.left(text, F.lit(300)).contains(HOOK_MARKER), "hook_blocked")
        .when(text.startswith(PERSISTED_PREFIX), "persisted")
        .otherwise("executed")
    )


def command_hook(text: Column) -> Column:
    named = F.concat(
        F.regexp_extract(text, HOOK_PATTERN, 1), F.lit(": "), F.left(F.regexp_extract(text, HOOK_PATTERN, 2), F.lit(90))
    )
    label = F.when(text.rlike(HOOK_PATTERN), named).otherwise(F.left(text, F.lit(90)))
    return F.when(command_state(text) == "hook_blocked", label)


def persisted_path(text: Column) -> Column:
    return F.when(command_state(text) == "persisted", F.nullif(F.regexp_extract(text, PERSISTED_PATH, 1), F.lit("")))


def persisted_kb(text: Column) -> Column:
    found = F.nullif(F.regexp_extract(text, PERSISTED_SIZE, 1), F.lit(""))
    return F.when(command_state(text) == "persisted", found.cast("double"))


def quantization(model_name: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(model_name, QUANTIZATION, 1)), F.lit(""))


def chunk_key(collection: Column, document: Column, chunk_index: Column) -> Column:
    return F.concat_ws("|", collection, document, chunk_index.cast("string"))


def share_text(part: Column, whole: Column) -> Column:
    """``part / whole (p%)`` with one decimal, halves to even; zero when the whole is zero."""
    percent = F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)
    return F.format_string("%d / %d (%.1f%%)", part.cast("long"), whole.cast("long"), F.bround(percent, 1))


def render_result(rank, score, collection, document, chunk_index, content, chunk_end=None) -> Column:
    """One printed result: header line, location line, content, blank line."""
    one = F.concat(F.lit("Chunk: "), chunk_index.cast("string"))
    place = one
    if chunk_end is not None:
        many = F.concat(F.lit("Chunks: "), chunk_index.cast("string"), F.lit("-"), chunk_end.cast("string"))
        place = F.when(chunk_end.isNotNull() & (chunk_end != chunk_index), many).otherwise(one)
    return F.concat(
        F.lit("--- Result "), rank.cast("string"), F.lit(" (score: "), score.cast("string"), F.lit(") ---\n"),
        F.lit("Collection: "), collection, F.lit(" | Document: "), document, F.lit(" | "), place, F.lit("\n"),
        content, F.lit("\n"),
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def json_value(col: Column, is_text: bool) -> Column:
    """A scalar as Python's ``json.dumps`` writes it; ``to_json`` quotes text, and what is not printable ASCII becomes \\uXXXX."""
    if not is_text:
        return F.coalesce(col.cast("string"), F.lit("null"))
    array_text = F.to_json(F.array(col))
    bare = F.substring(array_text, 2, F.length(array_text) - 2)
    return F.when(col.isNull(), F.lit("null")).otherwise(_ascii(bare))


def _ascii(text: Column) -> Column:
    """Characters beyond printable ASCII as \\uXXXX, those beyond 16 bits as two surrogates."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(char: Column) -> Column:
        code = F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("long")
        high = F.lit(0xD800) + F.floor((code - 0x10000) / 0x400)
        return F.when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(F.lit(0xDC00) + (code - 0x10000) % 0x400)))

    odd = F.transform(F.regexp_extract_all(text, F.lit("([^\\x20-\\x7E])|([\\x20-\\x7E]+)"), F.lit(0)), lambda part: F.when(part.rlike("^[\\x20-\\x7E]"), part).otherwise(one(part)))
    return F.when(text.rlike("[^\\x20-\\x7E]"), F.array_join(odd, "")).otherwise(text)


def config_fingerprint(fields: dict[str, tuple[Column, bool]]) -> Column:
    """First 16 hex digits of SHA-256 over JSON with sorted keys and ``", "`` / ``": "`` separators.

    ``fields`` maps a key to (column, is_text). Equal to the JSON a Python writer emits.
    """
    parts = []
    for i, key in enumerate(sorted(fields)):
        col, is_text = fields[key]
        parts += [F.lit(f'{", " if i else ""}"{key}": '), json_value(col, is_text)]
    return F.left(F.sha2(F.concat(F.lit("{"), *parts, F.lit("}")).cast("binary"), 256), F.lit(16))
