"""Checks on segmented documents: line spans, themes, summaries and authored queries. Each check yields error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sondeo.functions import heavy, ordered, text
from sondeo.operators.retrieval import explode_words

# Limits of the checks, kinds of discarded spans, query formats.
MEDIAN_BLOCK_LINES_MAX = 25
BLOCKS_PER_100_LINES_MIN = 4.0
BLOCKS_PER_THEME_MIN = 2.0
WORD_BUDGET = (60, 90)
SUB_CONCEPTS = (3, 5)
OVERLAP_CEILING = 0.80
NGRAM_SIZE = 3
TRASH_TYPES = ["abstract_summary", "title_author", "references", "toc_index", "caption_stub", "conversion_residue", "navigation_meta"]
FORMATS = ["field_sentence", "keyword_bag", "natural_question"]

LINE_BLOCK = 8192   # lines of a document that one window task sees
LINE_BUCKET = 256   # lines per bucket of the overlap join


# -- line spans ----------------------------------------------------------------------------------------------------------

def out_of_bounds(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """Spans that start behind their end or leave the document (document, kind, label, problem)."""
    j = spans.join(totals, "document")
    problems = F.array_compact(F.array(
        F.when(F.col("line_start") > F.col("line_end"), F.lit("starts after its end")),
        F.when((F.col("line_start") < 1) | (F.col("line_end") > F.col("total_lines")), F.lit("out of document bounds")),
    ))
    return j.select("document", "kind", "label", F.explode(problems).alias("problem"))


def coverage_errors(spans: DataFrame, totals: DataFrame) -> DataFrame:
    """Spans (document, kind, label, pos, line_start, line_end) must tile lines 1..total without gap or overlap.

    The expected start is one past the previous span's end. A document with spans out of bounds reports only those.
    """
    bounds = out_of_bounds(spans, totals)
    clean = spans.join(bounds.select("document").distinct(), "document", "left_anti")
    order = ["line_start", "kind", "pos"]
    value = F.struct("line_start", "kind", "label")
    chained = ordered.next_row(clean, ["document"], order, F.floor(F.col("line_start") / LINE_BLOCK), value, "_after")
    gap = F.col("_after.line_start") - F.col("line_end") - 1
    inner = chained.filter(F.col("_after").isNotNull() & (gap != 0)).select(
        "document", F.col("_after.kind").alias("kind"), F.col("_after.label").alias("label"),
        F.when(gap > 0, F.lit("gap before span")).otherwise(F.lit("overlaps preceding span")).alias("problem"))
    edges = clean.groupBy("document").agg(
        F.min_by(value, F.struct(*order)).alias("first"), F.max_by("line_end", F.struct(*order)).alias("last_end")).join(totals, "document")
    start = edges.filter(F.col("first.line_start") > 1).select("document", "first.kind", "first.label", F.lit("gap before span").alias("problem"))
    end = edges.filter(F.col("last_end") != F.col("total_lines")).select(
        "document", F.lit("document").alias("kind"), F.lit("end").alias("label"), F.lit("coverage ends at another line").alias("problem"))
    return bounds.unionByName(inner).unionByName(start).unionByName(end)


def theme_span_overlaps(spans: DataFrame) -> DataFrame:
    """Consecutive spans of one theme that share lines."""
    chained = ordered.next_row(
        spans, ["document", "theme_id"], ["line_start", "line_end"], F.floor(F.col("line_start") / LINE_BLOCK),
        F.struct("line_start", "line_end"), "_after")
    return chained.filter(F.col("line_end") >= F.col("_after.line_start")).select(
        "document", "theme_id", "line_start", "line_end", F.col("_after.line_start").alias("next_start"), F.col("_after.line_end").alias("next_end"))


def overlapping_spans(left: DataFrame, right: DataFrame, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Pairs of spans that share a line, found by an equality on (document, line bucket) instead of a range join."""
    def buckets(df):
        first, last = F.floor(F.col("line_start") / LINE_BUCKET), F.floor(F.col("line_end") / LINE_BUCKET)
        return df.filter("line_start <= line_end").withColumn("_first", first).withColumn("_bucket", F.explode(F.sequence(first, last)))

    l = buckets(left).select("document", "_bucket", *left_cols, F.col("line_start").alias("l_start"), F.col("line_end").alias("l_end"), F.col("_first").alias("l_first"))
    r = buckets(right).select("document", "_bucket", *right_cols, F.col("line_start").alias("r_start"), F.col("line_end").alias("r_end"), F.col("_first").alias("r_first"))
    joined = l.join(r, ["document", "_bucket"]).filter((F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")))
    # A pair that shares several buckets is reported in the first one only.
    return joined.filter(F.col("_bucket") == F.greatest("l_first", "r_first")).select(
        "document", *left_cols, "l_start", "l_end", *right_cols, "r_start", "r_end")


def with_span_cover(units: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``covered`` (one span holds the whole unit) and ``touched`` (some span shares a line).

    Both are running maxima over span starts: the furthest end among spans that begin by the unit's start, or by its
    end. No (unit, span) pair is formed.
    """
    units = units.withColumn("_s", F.col("line_start").cast("long")).withColumn("_e", F.col("line_end").cast("long"))
    marks = spans.select("document", F.col("line_start").cast("long").alias("_start"), F.col("line_end").cast("long").alias("_end"))
    one = ordered.largest_before(units, marks, ["document"], "_s", "_start", F.col("_end"), LINE_BLOCK, "_by_start")
    two = ordered.largest_before(one, marks, ["document"], "_e", "_start", F.col("_end"), LINE_BLOCK, "_by_end")
    return two.withColumn("covered", F.coalesce(F.col("_by_start") >= F.col("_e"), F.lit(False))).withColumn(
        "touched", F.coalesce(F.col("_by_end") >= F.col("_s"), F.lit(False))).drop("_s", "_e", "_by_start", "_by_end")


def block_units(blocks: DataFrame, resplits: DataFrame) -> DataFrame:
    """Blocks, with re-split ones replaced by their parts (document, block_id, line_start, line_end)."""
    whole = blocks.select("document", F.col("id").alias("block_id"), "line_start", "line_end")
    parts = resplits.select("document", "block_id", "line_start", "line_end")
    keys = ["document", "block_id"]
    known = parts.join(whole.select(*keys), keys, "left_semi")
    return whole.join(parts.select(*keys).distinct(), keys, "left_anti").unionByName(known)


def assignment_errors(units: DataFrame, spans: DataFrame, unassigned: DataFrame) -> DataFrame:
    """Every unit is either covered by a theme span or listed as unassigned and untouched."""
    listed = unassigned.select("document", F.col("block").alias("block_id")).distinct().withColumn("_listed", F.lit(True))
    j = with_span_cover(units, spans).join(listed, ["document", "block_id"], "left")
    on_list = F.coalesce("_listed", F.lit(False))
    problem = (
        F.when(F.col("covered") & on_list, "covered but listed as unassigned")
        .when(F.col("covered"), F.lit(None))
        .when(on_list & F.col("touched"), "listed as unassigned but partly covered")
        .when(on_list, F.lit(None))
        .when(F.col("touched"), "partly covered").otherwise("not covered")
    )
    return j.select("document", "block_id", "line_start", "line_end", problem.alias("problem")).filter(F.col("problem").isNotNull())


def resplit_errors(parts: DataFrame, blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Parts (document, block_id, line_start, line_end) rebuild their block, follow each other, and break on blank lines."""
    keys = ["document", "block_id"]
    whole = blocks.select("document", F.col("id").alias("block_id"), F.col("line_start").alias("b_start"), F.col("line_end").alias("b_end"))
    def error(df, problem, at): return df.select(*keys, at.cast("int").alias("line"), F.lit(problem).alias("problem"))
    unknown = error(parts.select(*keys).distinct().join(whole, keys, "left_anti"), "unknown block", F.lit(None))
    known = parts.join(whole.select(*keys), keys, "left_semi")
    edges = known.groupBy(*keys).agg(F.min("line_start").alias("first"), F.max_by("line_end", "line_start").alias("last")).join(whole, keys)
    rebuilt = error(edges.filter((F.col("first") != F.col("b_start")) | (F.col("last") != F.col("b_end"))), "does not rebuild block", F.col("first"))
    chained = ordered.next_row(known, keys, ["line_start"], F.floor(F.col("line_start") / LINE_BLOCK), F.struct("line_start"), "_after").filter(
        F.col("_after").isNotNull())
    follows = F.col("_after.line_start") == F.col("line_end") + 1
    broken = error(chained.filter(~follows), "gap or overlap", F.col("line_end"))
    borders = chained.filter(follows).select(*keys, F.col("line_end").alias("line_no"))
    filled = borders.join(lines, ["document", "line_no"]).filter(text.strip_ws(F.col("text")) != "")
    return unknown.unionByName(rebuilt).unionByName(broken).unionByName(error(filled, "border is not a blank line", F.col("line_no")))


def granularity(blocks: DataFrame, totals: DataFrame) -> DataFrame:
    """Median block size and blocks per 100 lines, with their limits. Sizes are whole numbers up to the document length."""
    sized = blocks.groupBy("document").agg(F.median(F.col("line_end") - F.col("line_start") + 1).alias("median_lines"), F.count("*").alias("blocks"))
    return sized.join(totals, "document").select(
        "document", "median_lines", "blocks", (F.col("blocks") / F.col("total_lines") * 100).alias("per_100")
    ).withColumn("too_coarse", (F.col("median_lines") > MEDIAN_BLOCK_LINES_MAX) | (F.col("per_100") < BLOCKS_PER_100_LINES_MIN))


def blocks_per_theme(blocks: DataFrame, themes: DataFrame, unassigned: DataFrame) -> DataFrame:
    """Assignable blocks per theme and document; documents without themes have ratio 0."""
    b = blocks.groupBy("document").agg(F.count("*").alias("blocks"))
    t = themes.groupBy("document").agg(F.count("*").alias("themes"))
    u = unassigned.groupBy("document").agg(F.count("*").alias("unassigned"))
    j = b.join(t, "document", "left").join(u, "document", "left").fillna(0, ["themes", "unassigned"])
    ratio = F.when(F.col("themes") > 0, (F.col("blocks") - F.col("unassigned")) / F.col("themes")).otherwise(0.0)
    return j.select("document", "blocks", "themes", "unassigned", ratio.alias("ratio")).withColumn("too_fine", F.col("ratio") < BLOCKS_PER_THEME_MIN)


# -- references ----------------------------------------------------------------------------------------------------------

def trash_type_errors(trash: DataFrame) -> DataFrame:
    return trash.filter(~F.col("type").isin(TRASH_TYPES))


def missing_keys(df: DataFrame, required: list[str], labels: list[str]) -> DataFrame:
    """Rows of parsed artefacts in which a required field is absent."""
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(required)]))
    return df.select(*labels, absent.alias("missing")).filter(F.size("missing") > 0)


def soft_member_errors(members: DataFrame, blocks: DataFrame, spans: DataFrame, themes: DataFrame) -> DataFrame:
    """Soft members (document, theme_id, block, also_in[]) overlap their own theme and point at other, existing themes."""
    whole = blocks.select("document", F.col("id").alias("block"), "line_start", "line_end")
    j = members.join(whole, ["document", "block"], "left")
    cols = ["document", "theme_id", "block"]
    def error(df, problem, detail=F.lit(None)): return df.select(*cols, F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    unknown = error(j.filter(F.col("line_start").isNull()), "unknown block")
    known = j.filter(F.col("line_start").isNotNull())
    own = with_theme_cover(known, spans)
    apart = error(own.filter(~F.col("touched")), "does not overlap own theme")
    refs = known.select(*cols, F.explode("also_in").alias("other"))
    existing = themes.select("document", F.col("id").alias("other"))
    lost = error(refs.join(existing, ["document", "other"], "left_anti"), "unknown theme", F.col("other"))
    itself = error(refs.filter(F.col("other") == F.col("theme_id")), "refers to itself", F.col("other"))
    return unknown.unionByName(apart).unionByName(lost).unionByName(itself)


def with_theme_cover(members: DataFrame, spans: DataFrame) -> DataFrame:
    """``touched``: a span of the member's own theme shares a line with its block."""
    pts = members.withColumn("_e", F.col("line_end").cast("long"))
    marks = spans.select("document", "theme_id", F.col("line_start").cast("long").alias("_start"), F.col("line_end").alias("_end"))
    reach = ordered.largest_before(pts, marks, ["document", "theme_id"], "_e", "_start", F.col("_end"), LINE_BLOCK, "_reach")
    return reach.withColumn("touched", F.coalesce(F.col("_reach") >= F.col("line_start"), F.lit(False))).drop("_e", "_reach")


def id_set_errors(have: DataFrame, want: DataFrame) -> DataFrame:
    """Duplicate, missing and unknown (document, theme_id)."""
    keys = ["document", "theme_id"]
    counts = have.groupBy(*keys).agg(F.count("*").alias("n"))
    wanted = want.select(*keys).distinct().withColumn("_want", F.lit(True))
    j = counts.join(wanted, keys, "full_outer")
    problems = F.array_compact(F.array(
        F.when(F.col("n") > 1, F.lit("duplicate")), F.when(F.col("n").isNull(), F.lit("missing")), F.when(F.col("_want").isNull(), F.lit("unknown"))))
    return j.select(*keys, F.explode(problems).alias("problem"))


def format_errors(queries: DataFrame, themes: DataFrame) -> DataFrame:
    """Each theme has exactly the three formats, once each; unknown and missing themes are reported."""
    keys = ["document", "theme_id"]
    per = queries.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("format")).alias("formats"))
    wanted = themes.select(*keys).distinct().withColumn("_want", F.lit(True))
    j = per.join(wanted, keys, "full_outer")
    wrong = (F.col("n") != len(FORMATS)) | (F.array_join("formats", ",") != ",".join(FORMATS))
    problems = F.array_compact(F.array(
        F.when(F.col("_want").isNull(), F.lit("unknown theme")), F.when(F.col("n").isNull(), F.lit("missing theme")),
        F.when(F.col("n").isNotNull() & wrong, F.lit("wrong formats"))))
    return j.select(*keys, F.explode(problems).alias("problem"))


# -- texts ---------------------------------------------------------------------------------------------------------------

def summary_text() -> Column:
    return F.concat_ws(" ", "field", "information_need", F.array_join("sub_concepts", " "), "answer_type")


def summary_errors(summaries: DataFrame) -> DataFrame:
    """Names of the broken rules per summary, in the order of the rules."""
    need, concept, subs = F.col("information_need"), F.col("primary_concept"), F.col("sub_concepts")
    structure = F.array(*[F.lit(w) for w in text.STRUCTURE_WORDS])
    # Texts are cut into words and stems once per row, before the rules read them.
    prepared = summaries.withColumn("_words", F.size(text.blank_split(summary_text()))).withColumn(
        "_tokens", F.transform(text.words(summary_text()), F.lower)).withColumn(
        "_concept", F.array_distinct(text.stems(concept))).withColumn("_clause", F.array_distinct(text.stems(text.leading_clause(need))))
    stray = F.exists(subs, lambda s: F.regexp_replace(s, text.BRACKETED_NUMBERS, "").rlike(r"\d"))
    digits = F.col("field").rlike(r"\d") | need.rlike(r"\d") | F.col("answer_type").rlike(r"\d")
    present = F.size(F.array_intersect("_concept", "_clause"))
    rules = [
        (~F.col("_words").between(*WORD_BUDGET), "word_budget"),
        (~F.size(subs).between(*SUB_CONCEPTS), "sub_concepts_count"),
        (stray, "digits_in_sub_concept"),
        (digits, "digits_in_text"),
        (F.arrays_overlap("_tokens", structure), "structure_reference"),
        (~F.array_contains(subs, concept), "primary_concept_not_listed"),
        (present * 2 < F.size("_concept"), "clause_lacks_concept"),
        (need.rlike(f"(?i){text.LOOKUP_PHRASING}"), "lookup_phrasing"),
    ]
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    return prepared.select("document", "theme_id", broken.alias("errors"))


def head_concept_errors(queries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Keyword bags open with the concept; other formats carry it, unbroken, in their leading clause."""
    c = summaries.select("document", "theme_id", text.stems(F.col("primary_concept")).alias("_concept"))
    j = queries.join(c, ["document", "theme_id"])
    bag = F.slice(text.stems(F.col("query")), F.lit(1), F.size("_concept"))
    padded = lambda arr: F.concat(F.lit(" "), F.array_join(arr, " "), F.lit(" "))
    opens = F.when(F.size("_concept") == 0, F.lit(True)).otherwise(bag == F.col("_concept"))
    carries = F.contains(padded(text.stems(text.leading_clause(F.col("query")))), padded(F.col("_concept")))
    ok = F.when(F.col("format") == "keyword_bag", opens).otherwise(carries)
    return j.filter(~ok).select("document", "theme_id", "format", "query")


def overlap_ratios(queries: DataFrame, summaries: DataFrame) -> DataFrame:
    """Share of a query's distinct stems that its information need holds; keyword bags and stemless queries are exempt."""
    n = summaries.select("document", "theme_id", F.array_distinct(text.stems(F.col("information_need"))).alias("_need"))
    j = queries.filter(F.col("format") != "keyword_bag").join(n, ["document", "theme_id"]).withColumn(
        "_query", F.array_distinct(text.stems(F.col("query"))))
    ratio = F.size(F.array_intersect("_query", "_need")) / F.size("_query")
    return j.filter(F.size("_query") > 0).select("document", "theme_id", "format", ratio.alias("overlap")).withColumn(
        "too_close", F.col("overlap") > OVERLAP_CEILING)


def shared_ngrams(pairs: DataFrame, passage: str, summary: str, n: int = NGRAM_SIZE) -> DataFrame:
    """Adds ``shared``: sorted n-grams of content words found in both texts of a row."""
    tokens = pairs.withColumn("_p", text.content_words(F.col(passage))).withColumn("_s", text.content_words(F.col(summary)))
    grams = tokens.withColumn("_pg", text.ngrams(F.col("_p"), n)).withColumn("_sg", text.ngrams(F.col("_s"), n))
    return grams.withColumn("shared", F.array_sort(F.array_intersect("_pg", "_sg"))).drop("_p", "_s", "_pg", "_sg")


def corpus_leakage(passages: DataFrame, summaries: DataFrame, n: int = NGRAM_SIZE) -> DataFrame:
    """Shared n-grams per (summary, passage) over the whole corpus, by an equality on the n-gram.

    N-grams found in very many passages are spread, as many ways as they need; sums are combined before the last shuffle.
    """
    def grams(df, key):
        cut = df.select(key, text.content_words(F.col("text")).alias("_w"))
        return explode_words(cut.select(key, text.ngrams(F.col("_w"), n).alias("_g")), [key], "_g", "gram")

    joined = heavy.spread_join(grams(passages, "passage_id"), grams(summaries, "summary_id"), ["gram"], ["passage_id"])
    return joined.groupBy("summary_id", "passage_id").agg(F.count("*").alias("shared"))


def passage_texts(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of each theme joined by blanks, spans in the order given by ``pos``."""
    wanted = spans.select("document", "theme_id", "pos", F.explode(F.sequence("line_start", "line_end")).alias("line_no"))
    return wanted.join(lines, ["document", "line_no"]).groupBy("document", "theme_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line_no", "text"))), lambda s: s["text"]), " ").alias("passage"))
