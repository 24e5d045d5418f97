"""Queries on segmented documents: conversations play the documents, turns the spans."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from sondeo.catalog.base import ctes, query, table
from sondeo.catalog.text_functions import clause_sql, stems_sql, words_sql
from sondeo.functions import text
from sondeo.operators import segments as sg
from sondeo.sources import evalsets

# A turn covers length // 60 + 1 lines. Some spans are shifted so that every kind of error occurs.
TURNS = """sized AS (SELECT conv_id, turn, role, text, (length(text) // 60 + 1)::INT AS n FROM conversations),
placed AS (SELECT *, (sum(n) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS e FROM sized),
turns AS (SELECT conv_id AS document, turn, role, text, n, (e - n + 1 + CASE WHEN conv_id % 5 = 1 AND turn = 2 THEN 1 WHEN conv_id % 11 = 3 AND turn = 0 THEN -1 ELSE 0 END)::INT AS line_start,
  (e + CASE WHEN conv_id % 5 = 2 AND turn = 1 THEN 1 ELSE 0 END)::INT AS line_end FROM placed),
totals AS (SELECT conv_id AS document, (max(e) + CASE WHEN conv_id % 6 = 5 THEN 1 ELSE 0 END)::INT AS total_lines FROM placed GROUP BY 1),
spans AS (SELECT document, CASE WHEN role = 'system' THEN 'trash' ELSE 'block' END AS kind, 'b' || turn::VARCHAR AS label, turn AS pos, line_start, line_end FROM turns),
blocks AS (SELECT document, label AS id, line_start, line_end, pos FROM spans WHERE kind = 'block'),
trash AS (SELECT document, pos, line_start, line_end, CASE document % 4 WHEN 0 THEN 'references' WHEN 1 THEN 'advert' ELSE 'toc_index' END AS type FROM spans WHERE kind = 'trash')"""


def turns(spark, sf):
    """Running line numbers by a window over the turns of a conversation: the stand-in's own set-up, a few rows each."""
    c = table(spark, sf, "conversations").withColumn("n", (F.floor(F.length("text") / 60) + 1).cast("int"))
    p = c.withColumn("e", F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    v, t = F.col("conv_id"), F.col("turn")
    return p.select(
        v.alias("document"), "turn", "role", "text", "n", "e",
        (F.col("e") - F.col("n") + 1 + F.when((v % 5 == 1) & (t == 2), 1).when((v % 11 == 3) & (t == 0), -1).otherwise(0)).alias("line_start"),
        (F.col("e") + F.when((v % 5 == 2) & (t == 1), 1).otherwise(0)).alias("line_end"))


def totals(t):
    return t.groupBy("document").agg(F.max("e").alias("m")).select("document", (F.col("m") + F.when(F.col("document") % 6 == 5, 1).otherwise(0)).alias("total_lines"))


def spans(t):
    return t.select("document", F.when(F.col("role") == "system", "trash").otherwise("block").alias("kind"), F.concat(F.lit("b"), F.col("turn").cast("string")).alias("label"),
                    F.col("turn").alias("pos"), "line_start", "line_end")


def blocks(t):
    return spans(t).filter("kind = 'block'").select("document", F.col("label").alias("id"), "line_start", "line_end", "pos")


def trash(t):
    d = F.col("document") % 4
    return spans(t).filter("kind = 'trash'").select("document", "pos", "line_start", "line_end", F.when(d == 0, "references").when(d == 1, "advert").otherwise("toc_index").alias("type"))


@query("w04_line_coverage", ctes(TURNS) + """,
bounds AS (SELECT document, kind, label, 'starts after its end' AS problem FROM spans WHERE line_start > line_end UNION ALL SELECT document, kind, label, 'out of document bounds' FROM spans JOIN totals USING (document) WHERE line_start < 1 OR line_end > total_lines),
chain AS (SELECT *, coalesce(lag(line_end) OVER w, 0) + 1 AS expected, row_number() OVER (PARTITION BY document ORDER BY line_start DESC, kind DESC, pos DESC) AS back FROM spans WHERE document NOT IN (SELECT document FROM bounds) WINDOW w AS (PARTITION BY document ORDER BY line_start, kind, pos))
SELECT * FROM bounds UNION ALL SELECT document, kind, label, CASE WHEN line_start < expected THEN 'overlaps preceding span' ELSE 'gap before span' END FROM chain WHERE line_start <> expected
UNION ALL SELECT document, 'document', 'end', 'coverage ends at another line' FROM chain JOIN totals USING (document) WHERE back = 1 AND line_end <> total_lines""")
def w04(spark, sf):
    t = turns(spark, sf)
    return sg.coverage_errors(spans(t), totals(t))


@query("a36_granularity", ctes(TURNS) + """
SELECT document, median(line_end - line_start + 1)::DOUBLE AS median_lines, count(*) AS blocks, round(count(*) / any_value(total_lines) * 100, 6) AS per_100,
 median(line_end - line_start + 1) > 25 OR count(*) / any_value(total_lines) * 100 < 4 AS too_coarse FROM blocks JOIN totals USING (document) GROUP BY 1""")
def a36(spark, sf):
    t = turns(spark, sf)
    return sg.granularity(blocks(t), totals(t)).withColumn("per_100", F.round("per_100", 6))


# Themes: two turns each; some parts are left out, shortened or stretched.
THEMES = """tspans AS (SELECT document, 't' || (turn // 2)::VARCHAR AS theme_id, (line_start - (document % 4 = 3)::INT)::INT AS line_start, (line_end + CASE WHEN document % 4 = 1 THEN -1 WHEN document % 9 = 2 AND turn % 2 = 0 THEN 2 ELSE 0 END)::INT AS line_end, turn AS pos
  FROM turns WHERE role <> 'system' AND NOT (document % 3 = 0 AND turn % 2 = 1)),
themes AS (SELECT DISTINCT document, theme_id FROM tspans),
unassigned AS (SELECT document, 'b' || turn::VARCHAR AS block FROM turns WHERE role <> 'system' AND document % 2 = 0 AND document % 3 = 0 AND turn % 2 = 1 UNION ALL SELECT document, 'b0' FROM turns WHERE turn = 0 AND document % 13 = 5),
resplits AS (SELECT document, id AS block_id, part, (CASE part WHEN 1 THEN line_start ELSE mid + 1 + (document % 8 = 6)::INT END)::INT AS line_start, (CASE part WHEN 1 THEN mid ELSE line_end - (document % 16 = 2)::INT END)::INT AS line_end
  FROM (SELECT *, (line_start + line_end) // 2 AS mid FROM blocks WHERE document % 4 = 2 AND line_end - line_start >= 4), (VALUES (1), (2)) p(part) UNION ALL SELECT document, 'b77', 1, 1, 2 FROM totals WHERE document % 10 = 0),
text_lines AS (SELECT document, (line_end - n + i)::INT AS line_no, CASE WHEN (line_end - n + i) % 3 = 0 THEN '  ' ELSE substr(text, (60 * (i - 1) + 1)::INT, 60) END AS text FROM (SELECT conv_id AS document, text, n, e AS line_end FROM placed), unnest(range(1, n + 1)) AS u(i))"""


def theme_spans(t):
    d, n = F.col("document"), F.col("turn")
    return t.filter((F.col("role") != "system") & ~((d % 3 == 0) & (n % 2 == 1))).select(
        "document", F.concat(F.lit("t"), F.floor(n / 2).cast("string")).alias("theme_id"), (F.col("line_start") - (d % 4 == 3).cast("int")).alias("line_start"),
        (F.col("line_end") + F.when(d % 4 == 1, -1).when((d % 9 == 2) & (n % 2 == 0), 2).otherwise(0)).alias("line_end"), n.alias("pos"))


def unassigned(t):
    d, n = F.col("document"), F.col("turn")
    one = t.filter((F.col("role") != "system") & (d % 2 == 0) & (d % 3 == 0) & (n % 2 == 1)).select("document", F.concat(F.lit("b"), n.cast("string")).alias("block"))
    return one.unionByName(t.filter((n == 0) & (d % 13 == 5)).select("document", F.lit("b0").alias("block")))


def resplits(t):
    d = F.col("document")
    b = blocks(t).filter((d % 4 == 2) & (F.col("line_end") - F.col("line_start") >= 4)).withColumn("mid", F.floor((F.col("line_start") + F.col("line_end")) / 2).cast("int")).withColumn("part", F.explode(F.array(F.lit(1), F.lit(2))))
    first = F.col("part") == 1
    parts = b.select("document", F.col("id").alias("block_id"), F.when(first, F.col("line_start")).otherwise(F.col("mid") + 1 + (d % 8 == 6).cast("int")).alias("line_start"),
                     F.when(first, F.col("mid")).otherwise(F.col("line_end") - (d % 16 == 2).cast("int")).alias("line_end"))
    return parts.unionByName(totals(t).filter(d % 10 == 0).select("document", F.lit("b77").alias("block_id"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end")))


def text_lines(t):
    at = F.col("e") - F.col("n") + F.col("i")
    return t.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select(
        "document", at.alias("line_no"), F.when(at % 3 == 0, "  ").otherwise(F.substring("text", 60 * (F.col("i") - 1) + 1, F.lit(60))).alias("text"))


@query("w05_theme_span_overlaps", ctes(TURNS, THEMES) + """
SELECT * FROM (SELECT document, theme_id, line_start, line_end, lead(line_start) OVER w AS next_start, lead(line_end) OVER w AS next_end FROM tspans WINDOW w AS (PARTITION BY document, theme_id ORDER BY line_start, line_end)) WHERE line_end >= next_start""")
def w05(spark, sf):
    return sg.theme_span_overlaps(theme_spans(turns(spark, sf)))


@query("w06_resplit_errors", ctes(TURNS, THEMES) + """,
known AS (SELECT r.*, b.line_start AS b_start, b.line_end AS b_end FROM resplits r JOIN blocks b ON b.document = r.document AND b.id = r.block_id),
chain AS (SELECT *, lead(line_start) OVER (PARTITION BY document, block_id ORDER BY line_start) AS nxt FROM known)
SELECT document, block_id, NULL::INT AS line, 'unknown block' AS problem FROM (SELECT DISTINCT document, block_id FROM resplits) r WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.document = r.document AND b.id = r.block_id)
UNION ALL SELECT document, block_id, min(line_start), 'does not rebuild block' FROM known GROUP BY document, block_id HAVING min(line_start) <> any_value(b_start) OR arg_max(line_end, line_start) <> any_value(b_end)
UNION ALL SELECT document, block_id, line_end, 'gap or overlap' FROM chain WHERE nxt <> line_end + 1
UNION ALL SELECT c.document, block_id, line_end, 'border is not a blank line' FROM chain c JOIN text_lines l ON l.document = c.document AND l.line_no = c.line_end WHERE nxt = line_end + 1 AND trim(l.text, chr(10) || chr(9) || ' ') <> ''""")
def w06(spark, sf):
    t = turns(spark, sf)
    return sg.resplit_errors(resplits(t), blocks(t), text_lines(t))


@query("j12_span_cover", ctes(TURNS, THEMES) + """
SELECT b.document, b.id AS block_id, coalesce(bool_or(s.line_start <= b.line_start AND b.line_end <= s.line_end), false) AS covered, coalesce(bool_or(s.line_start <= b.line_end AND b.line_start <= s.line_end), false) AS touched
FROM blocks b LEFT JOIN tspans s USING (document) GROUP BY ALL""")
def j12(spark, sf):
    t = turns(spark, sf)
    units = blocks(t).select("document", F.col("id").alias("block_id"), "line_start", "line_end")
    return sg.with_span_cover(units, theme_spans(t)).select("document", "block_id", "covered", "touched")


@query("j12_trash_overlaps", ctes(TURNS, THEMES) + """
SELECT s.document, s.theme_id, s.line_start AS l_start, s.line_end AS l_end, t.pos, t.line_start AS r_start, t.line_end AS r_end FROM tspans s JOIN trash t ON t.document = s.document AND s.line_start <= t.line_end AND t.line_start <= s.line_end
WHERE s.line_start <= s.line_end""")
def j12b(spark, sf):
    t = turns(spark, sf)
    return sg.overlapping_spans(theme_spans(t), trash(t), ["theme_id"], ["pos"])


@query("j12_assignment_errors", ctes(TURNS, THEMES) + """,
units AS (SELECT document, id AS block_id, line_start, line_end FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM resplits r WHERE r.document = b.document AND r.block_id = b.id) UNION ALL
 SELECT document, block_id, line_start, line_end FROM resplits r WHERE EXISTS (SELECT 1 FROM blocks b WHERE r.document = b.document AND r.block_id = b.id)),
c AS (SELECT u.*, EXISTS (SELECT 1 FROM tspans s WHERE s.document = u.document AND s.line_start <= u.line_start AND u.line_end <= s.line_end) AS cov, EXISTS (SELECT 1 FROM tspans s WHERE s.document = u.document AND s.line_start <= u.line_end AND u.line_start <= s.line_end) AS tch,
 EXISTS (SELECT 1 FROM unassigned n WHERE n.document = u.document AND n.block = u.block_id) AS lst FROM units u),
p AS (SELECT document, block_id, line_start, line_end, CASE WHEN cov AND lst THEN 'covered but listed as unassigned' WHEN cov THEN NULL WHEN lst AND tch THEN 'listed as unassigned but partly covered' WHEN lst THEN NULL WHEN tch THEN 'partly covered' ELSE 'not covered' END AS problem FROM c)
SELECT * FROM p WHERE problem IS NOT NULL""")
def j12c(spark, sf):
    t = turns(spark, sf)
    return sg.assignment_errors(sg.block_units(blocks(t), resplits(t)), theme_spans(t), unassigned(t))


@query("a36_blocks_per_theme", ctes(TURNS, THEMES) + """
SELECT b.document, blocks, coalesce(themes, 0) AS themes, coalesce(unassigned, 0) AS unassigned, round(CASE WHEN coalesce(themes, 0) > 0 THEN (blocks - coalesce(unassigned, 0)) / themes ELSE 0 END, 6)::DOUBLE AS ratio,
 CASE WHEN coalesce(themes, 0) > 0 THEN (blocks - coalesce(unassigned, 0)) / themes ELSE 0 END < 2 AS too_fine
FROM (SELECT document, count(*) AS blocks FROM blocks GROUP BY 1) b LEFT JOIN (SELECT document, count(*) AS themes FROM themes GROUP BY 1) t USING (document) LEFT JOIN (SELECT document, count(*) AS unassigned FROM unassigned GROUP BY 1) u USING (document)""")
def a36b(spark, sf):
    t = turns(spark, sf)
    return sg.blocks_per_theme(blocks(t), theme_spans(t).select("document", "theme_id").distinct(), unassigned(t)).withColumn("ratio", F.round("ratio", 6))


@query("u06_trash_types", ctes(TURNS) + "SELECT document, pos, type FROM trash WHERE type = 'advert'")
def u06(spark, sf):
    return sg.trash_type_errors(trash(turns(spark, sf))).select("document", "pos", "type")


MEMBERS = """members AS (SELECT document, 't0' AS theme_id, 'b' || (document % 5)::VARCHAR AS block, ['t1', 't' || (document % 4)::VARCHAR] AS also_in FROM totals)"""


@query("u06_soft_members", ctes(TURNS, THEMES, MEMBERS) + """,
m AS (SELECT m.*, b.line_start, b.line_end FROM members m LEFT JOIN blocks b ON b.document = m.document AND b.id = m.block), r AS (SELECT *, unnest(also_in) AS o FROM m WHERE line_start IS NOT NULL)
SELECT document, theme_id, block, 'unknown block' AS problem, NULL AS detail FROM m WHERE line_start IS NULL
UNION ALL SELECT document, theme_id, block, 'does not overlap own theme', NULL FROM m WHERE line_start IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tspans s WHERE s.document = m.document AND s.theme_id = m.theme_id AND s.line_start <= m.line_end AND m.line_start <= s.line_end)
UNION ALL SELECT document, theme_id, block, 'unknown theme', o FROM r WHERE NOT EXISTS (SELECT 1 FROM themes t WHERE t.document = r.document AND t.theme_id = r.o)
UNION ALL SELECT document, theme_id, block, 'refers to itself', o FROM r WHERE o = theme_id""")
def u06b(spark, sf):
    t = turns(spark, sf)
    tag = F.concat(F.lit("t"), (F.col("document") % 4).cast("string"))
    members = totals(t).select("document", F.lit("t0").alias("theme_id"), F.concat(F.lit("b"), (F.col("document") % 5).cast("string")).alias("block"), F.array(F.lit("t1"), tag).alias("also_in"))
    themes = theme_spans(t).select("document", F.col("theme_id").alias("id")).distinct()
    return sg.soft_member_errors(members, blocks(t), theme_spans(t), themes)


@query("s14_span_tables", ctes(TURNS, THEMES) + "SELECT document::VARCHAR AS document, theme_id, line_start, line_end FROM tspans")
def s14(spark, sf):
    return evalsets.theme_spans(_pass_b(spark, sf))


def _pass_b(spark, sf):
    """Artefacts as nested records, as they come out of their JSON files."""
    per = theme_spans(turns(spark, sf)).groupBy(F.col("document").cast("string").alias("document"), F.col("theme_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("line_start", "line_end"))).alias("spans"))
    raw = per.groupBy("document").agg(F.collect_list(F.struct("id", F.lit("secret").alias("label"), "spans")).alias("themes"))
    lines = raw.select(F.to_json(F.struct("document", "themes")).alias("value"))
    return evalsets.themes(lines.select(F.from_json("value", evalsets.PASS_B).alias("r")).select("r.*"))


@query("f10_spans_only", ctes(TURNS, THEMES) + "SELECT document::VARCHAR AS document, theme_id AS id, string_agg(line_start::VARCHAR || '-' || line_end::VARCHAR, ',' ORDER BY line_start, line_end) AS spans FROM tspans GROUP BY ALL")
def f10(spark, sf):
    out = evalsets.spans_only(_pass_b(spark, sf))
    return out.select("document", "id", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["line_start"].cast("string"), s["line_end"].cast("string"))), ",").alias("spans"))


# -- summaries and queries: every turn is a theme ------------------------------------------------------------------------------

SUMMARIES = f"""w AS (SELECT conv_id AS document, 't' || turn::VARCHAR AS theme_id, turn, role AS field, text AS information_need, {words_sql('text')} AS w FROM conversations),
summaries AS (SELECT document, theme_id, turn, CASE WHEN turn = 3 THEN 'field 7' ELSE field END AS field, CASE WHEN document % 7 = 3 THEN 'who wants the proof of ' ELSE '' END || information_need AS information_need,
  coalesce(w[1 + document % 3], '') || ' ' || coalesce(w[2], '') AS primary_concept,
  [CASE WHEN document % 5 = 4 THEN 'other' ELSE coalesce(w[1 + document % 3], '') || ' ' || coalesce(w[2], '') END, 'order (1, 2)', CASE WHEN turn = 1 THEN 'model 12' ELSE 'chapter' END][1:2 + document % 2] AS sub_concepts, 'list' AS answer_type FROM w),
queries AS (SELECT document, theme_id, 'keyword_bag' AS format, CASE WHEN document % 4 = 0 THEN 'x ' ELSE '' END || primary_concept || ' more' AS query FROM summaries
 UNION ALL SELECT document, theme_id, CASE WHEN document % 9 = 4 THEN 'keyword_bag' ELSE 'natural_question' END, 'what ' || CASE WHEN document % 3 = 1 THEN '; ' ELSE '' END || primary_concept || ' does, and why?' FROM summaries
 UNION ALL SELECT document, theme_id, 'field_sentence', information_need FROM summaries WHERE turn <> 2)"""


def summaries(spark, sf):
    c = table(spark, sf, "conversations")
    d, t, w = F.col("document"), F.col("turn"), F.col("w")
    s = c.select(F.col("conv_id").alias("document"), "turn", F.col("role"), "text", text.words(F.col("text")).alias("w"))
    concept = F.concat(F.coalesce(F.get("w", (d % 3).cast("int")), F.lit("")), F.lit(" "), F.coalesce(F.get("w", 1), F.lit("")))
    subs = F.array(F.when(d % 5 == 4, "other").otherwise(concept), F.lit("order (1, 2)"), F.when(t == 1, "model 12").otherwise("chapter"))
    return s.select(
        "document", F.concat(F.lit("t"), t.cast("string")).alias("theme_id"), "turn", F.when(t == 3, "field 7").otherwise(F.col("role")).alias("field"),
        F.concat(F.when(d % 7 == 3, "who wants the proof of ").otherwise(""), F.col("text")).alias("information_need"), concept.alias("primary_concept"),
        F.slice(subs, F.lit(1), (2 + d % 2).cast("int")).alias("sub_concepts"), F.lit("list").alias("answer_type"))


def authored(s):
    d = F.col("document")
    bag = s.select("document", "theme_id", F.lit("keyword_bag").alias("format"), F.concat(F.when(d % 4 == 0, "x ").otherwise(""), F.col("primary_concept"), F.lit(" more")).alias("query"))
    ask = s.select("document", "theme_id", F.when(d % 9 == 4, "keyword_bag").otherwise("natural_question").alias("format"),
                   F.concat(F.lit("what "), F.when(d % 3 == 1, "; ").otherwise(""), F.col("primary_concept"), F.lit(" does, and why?")).alias("query"))
    field = s.filter("turn <> 2").select("document", "theme_id", F.lit("field_sentence").alias("format"), F.col("information_need").alias("query"))
    return bag.unionByName(ask).unionByName(field)


TEXT = "field || ' ' || information_need || ' ' || array_to_string(sub_concepts, ' ') || ' ' || answer_type"


@query("x06_summary_rules", ctes(SUMMARIES) + f""",
r AS (SELECT document, theme_id, len(list_filter(string_split_regex(trim(regexp_replace({TEXT}, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')), ' '), lambda x: x <> '')) AS n, len(sub_concepts) AS k,
 len(list_filter(sub_concepts, lambda s: regexp_matches(regexp_replace(s, '\\(\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\)', '', 'g'), '\\d'))) > 0 AS stray, regexp_matches(field, '\\d') OR regexp_matches(information_need, '\\d') OR regexp_matches(answer_type, '\\d') AS digits,
 list_has_any(list_transform({words_sql(TEXT)}, lambda w: lower(w)), ['section', 'appendix', 'paper', 'author', 'chapter']) AS struct_ref, list_contains(sub_concepts, primary_concept) AS member,
 list_distinct({stems_sql('primary_concept')}) AS c, list_distinct({stems_sql('(' + clause_sql('information_need') + ')')}) AS l, regexp_matches(information_need, '(?i)\\bwants?\\s+(?:the|a|an)\\s+(?:definition|statement|derivation|proof|formula|expression|theorem|lemma)\\b') AS lookup FROM summaries)
SELECT document, theme_id, array_to_string(list_filter([CASE WHEN n NOT BETWEEN 60 AND 90 THEN 'word_budget' END, CASE WHEN k NOT BETWEEN 3 AND 5 THEN 'sub_concepts_count' END, CASE WHEN stray THEN 'digits_in_sub_concept' END, CASE WHEN digits THEN 'digits_in_text' END,
 CASE WHEN struct_ref THEN 'structure_reference' END, CASE WHEN NOT member THEN 'primary_concept_not_listed' END, CASE WHEN len(list_intersect(c, l)) * 2 < len(c) THEN 'clause_lacks_concept' END, CASE WHEN lookup THEN 'lookup_phrasing' END], lambda x: x IS NOT NULL), ',') AS errors FROM r""")
def x06(spark, sf):
    return sg.summary_errors(summaries(spark, sf)).select("document", "theme_id", F.array_join("errors", ",").alias("errors"))


@query("x07_head_concept", ctes(SUMMARIES) + f""",
j AS (SELECT q.*, {stems_sql('s.primary_concept')} AS c, {stems_sql('q.query')} AS qs, {stems_sql('(' + clause_sql('q.query') + ')')} AS cl FROM queries q JOIN summaries s USING (document, theme_id))
SELECT document, theme_id, format, query FROM j WHERE CASE WHEN format = 'keyword_bag' THEN coalesce(array_to_string(qs[1:len(c)], ' '), '') <> coalesce(array_to_string(c, ' '), '') ELSE NOT contains(' ' || coalesce(array_to_string(cl, ' '), '') || ' ', ' ' || coalesce(array_to_string(c, ' '), '') || ' ') END""")
def x07(spark, sf):
    s = summaries(spark, sf)
    return sg.head_concept_errors(authored(s), s)


@query("u02_id_set_check", ctes(SUMMARIES, """have AS (SELECT document, theme_id FROM summaries WHERE turn <> 1 UNION ALL SELECT document, 't0' FROM summaries WHERE turn = 2 UNION ALL SELECT document, 't9' FROM summaries WHERE turn = 4)""") + """,
n AS (SELECT document, theme_id, count(*) AS n FROM have GROUP BY ALL)
SELECT document, theme_id, 'duplicate' AS problem FROM n WHERE n > 1 UNION ALL SELECT document, theme_id, 'unknown' FROM n WHERE (document, theme_id) NOT IN (SELECT (document, theme_id) FROM summaries)
UNION ALL SELECT document, theme_id, 'missing' FROM summaries WHERE (document, theme_id) NOT IN (SELECT (document, theme_id) FROM n)""")
def u02(spark, sf):
    s = summaries(spark, sf).select("document", "theme_id", "turn")
    have = s.filter("turn <> 1").unionByName(s.filter("turn = 2").withColumn("theme_id", F.lit("t0"))).unionByName(s.filter("turn = 4").withColumn("theme_id", F.lit("t9")))
    return sg.id_set_errors(have, s)


@query("u03_format_completeness", ctes(SUMMARIES) + """,
themes AS (SELECT document, theme_id FROM summaries WHERE document % 8 <> 7 OR turn <> 0 UNION ALL SELECT DISTINCT document, 't99' FROM summaries WHERE document % 10 = 1),
f AS (SELECT document, theme_id, count(*) AS n, string_agg(DISTINCT format, ',' ORDER BY format) AS f FROM queries GROUP BY ALL)
SELECT document, theme_id, 'unknown theme' AS problem FROM f WHERE (document, theme_id) NOT IN (SELECT (document, theme_id) FROM themes) UNION ALL SELECT document, theme_id, 'missing theme' FROM themes WHERE (document, theme_id) NOT IN (SELECT (document, theme_id) FROM f)
UNION ALL SELECT document, theme_id, 'wrong formats' FROM f WHERE n <> 3 OR f <> 'field_sentence,keyword_bag,natural_question'""")
def u03(spark, sf):
    s = summaries(spark, sf)
    known = s.filter("document % 8 <> 7 OR turn <> 0").select("document", "theme_id")
    extra = s.filter("document % 10 = 1").select("document", F.lit("t99").alias("theme_id")).distinct()
    return sg.format_errors(authored(s), known.unionByName(extra))


@query("u04_overlap_ratio", ctes(SUMMARIES) + f""",
j AS (SELECT q.document, q.theme_id, q.format, list_distinct({stems_sql('q.query')}) AS a, list_distinct({stems_sql('s.information_need')}) AS b FROM queries q JOIN summaries s USING (document, theme_id) WHERE format <> 'keyword_bag')
SELECT document, theme_id, format, round(len(list_intersect(a, b)) / len(a), 6) AS overlap, len(list_intersect(a, b)) / len(a) > 0.8 AS too_close FROM j WHERE len(a) > 0""")
def u04(spark, sf):
    s = summaries(spark, sf)
    return sg.overlap_ratios(authored(s), s).withColumn("overlap", F.round("overlap", 6))
