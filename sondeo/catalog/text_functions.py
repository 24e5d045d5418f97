"""Queries on the column expressions for texts, log fields and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.catalog import standins as st
from sondeo.catalog.base import ctes, query, table, text_table
from sondeo.catalog.tables import norm_sql
from sondeo.functions import logs as lf
from sondeo.functions import text
from sondeo.operators import loganalytics, segments

WORDS_SQL = "regexp_extract_all({}, '([A-Za-z][A-Za-z\\-'']*)', 1)"


def words_sql(t: str) -> str:
    return "regexp_extract_all(" + t + r", '([A-Za-z][A-Za-z\-'']*)', 1)"


def content_words_sql(t: str) -> str:
    stops = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    return f"list_filter(list_transform({words_sql(t)}, lambda w: lower(w)), lambda w: NOT list_contains([{stops}], w))"


def stem_sql(w: str) -> str:
    b = f"regexp_replace(lower({w}), '[^a-z0-9]', '', 'g')"
    return f"""left(CASE WHEN length({b}) <= 4 THEN {b} WHEN {b} LIKE '%ies' THEN left({b}, length({b}) - 3) || 'y' WHEN {b} LIKE '%es' THEN left({b}, length({b}) - 2)
 WHEN {b} LIKE '%s' AND {b} NOT LIKE '%ss' THEN left({b}, length({b}) - 1) WHEN {b} LIKE '%ing' THEN left({b}, length({b}) - 3)
 WHEN {b} LIKE '%ed' THEN left({b}, length({b}) - 2) ELSE {b} END, 7)"""


def stems_sql(t: str) -> str:
    return f"list_transform({words_sql(t)}, lambda w: {stem_sql('w')})"


def clause_sql(t: str) -> str:
    brk = r"(?:,[ \t\n\f\r\x0b]*(?:and|but|or)[ \t\n\f\r\x0b]+|[.;])"
    return f"""CASE WHEN regexp_matches({t}, '(?i){brk}') THEN regexp_extract({t}, '(?is)^(.*?){brk}', 1) ELSE regexp_replace({t}, '[?.! ]+$', '') END"""


def ngrams_sql(tokens: str, n: int = 3) -> str:
    joined = " || ' ' || ".join(f"{tokens}[i + {j}]" if j else f"{tokens}[i]" for j in range(n))
    return f"list_distinct(list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {joined}))"


def size_and_digest(col):
    return F.length(col).cast("long").alias("size"), F.sha2(col.cast("binary"), 256).alias("digest")


def list_digest(arr):
    return F.size(arr).cast("long").alias("n"), F.sha2(F.array_join(arr, " ").cast("binary"), 256).alias("digest")


def list_digest_sql(arr: str) -> str:
    return f"len({arr}) AS n, sha256(coalesce(array_to_string({arr}, ' '), '')) AS digest"


@query("x01_whitespace", f"SELECT page_id, length({norm_sql('html')}) AS size, sha256({norm_sql('html')}) AS digest FROM pages")
def x01(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", *size_and_digest(text.normalize_ws(F.col("html"))))


@query("x02_word_aligned_tail", """
SELECT doc_id, CASE WHEN position(' ' IN t) BETWEEN 1 AND length(t) - 1 THEN substr(t, position(' ' IN t) + 1) ELSE t END AS tail FROM (SELECT doc_id, right(text, 400) AS t FROM documents)""")
def x02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.word_aligned_tail(F.col("text"), 400).alias("tail"))


@query("x03_content_words", f"SELECT doc_id, {list_digest_sql('w')} FROM (SELECT doc_id, {content_words_sql('text')} AS w FROM documents)")
def x03(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", text.content_words(F.col("text")).alias("w")).select("doc_id", *list_digest(F.col("w")))


@query("x04_stems", f"SELECT doc_id, {list_digest_sql('w')} FROM (SELECT doc_id, {stems_sql('text')} AS w FROM documents)")
def x04(spark, sf):
    return text_table(spark, sf, "documents").select("doc_id", text.stems(F.col("text")).alias("w")).select("doc_id", *list_digest(F.col("w")))


@query("x05_leading_clause", f"SELECT conv_id, turn, {clause_sql('text')} AS clause FROM conversations")
def x05(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.leading_clause(F.col("text")).alias("clause"))


@query("x08_proof_label", r"SELECT doc_id FROM documents WHERE regexp_matches(CASE WHEN doc_id % 4 = 0 THEN replace(text, 'the', 'Proofs') ELSE text END, '(?i)\bproofs?\b')")
def x08(spark, sf):
    d = table(spark, sf, "documents").withColumn("label", F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("the"), F.lit("Proofs"))).otherwise(F.col("text")))
    return d.filter(text.is_proof_label(F.col("label"))).select("doc_id")


@query("x09_rendered_results", """
SELECT l_orderkey, l_linenumber, '--- Result ' || l_linenumber::VARCHAR || ' (score: ' || l_discount::VARCHAR || ') ---' || chr(10) || 'Collection: c' || l_suppkey::VARCHAR || ' | Document: d' || l_partkey::VARCHAR || ' | ' ||
 CASE WHEN l_partkey % 3 = 0 AND l_partkey % 6 <> 0 THEN 'Chunks: ' || l_linenumber::VARCHAR || '-' || (l_linenumber + 2)::VARCHAR ELSE 'Chunk: ' || l_linenumber::VARCHAR END || chr(10) || l_returnflag || chr(10) AS printed FROM lineitem""")
def x09(spark, sf):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    end = F.when(p % 3 == 0, F.when(p % 6 == 0, n).otherwise(n + 2))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", lf.render_result(
        n, F.col("l_discount"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string")), F.concat(F.lit("d"), p.cast("string")), n, F.col("l_returnflag"), end).alias("printed"))


STATE_SQL = "CASE WHEN contains(left(result_text, 300), 'hook error') THEN 'hook_blocked' WHEN starts_with(result_text, '<persisted-output>') THEN 'persisted' ELSE 'executed' END"
HOOK_RE = r"hook error: \[[^\]]*?([^/\s\]]+)\]: ([^\n]*)"


@query("x10_command_states", ctes(st.LOGS) + f"""
SELECT event_id, state, CASE WHEN state = 'hook_blocked' THEN regexp_extract(result_text, '{HOOK_RE}', 1) || ': ' || left(regexp_extract(result_text, '{HOOK_RE}', 2), 90) END AS hook,
 CASE WHEN state = 'persisted' THEN regexp_extract(result_text, 'saved to: (\\S+)', 1) END AS saved_path, CASE WHEN state = 'persisted' THEN regexp_extract(result_text, 'too large \\(([\\d.]+)KB', 1)::DOUBLE END AS persisted_kb
FROM (SELECT *, {STATE_SQL} AS state FROM calls)""")
def x10(spark, sf):
    t = F.col("result_text")
    return st.calls(spark, sf).select("event_id", lf.command_state(t).alias("state"), lf.command_hook(t).alias("hook"),
                                      lf.persisted_path(t).alias("saved_path"), lf.persisted_kb(t).alias("persisted_kb"))


@query("x11_project_of_folder", ctes(st.LOGS) + """
SELECT event_id, CASE WHEN cwd LIKE '%/alpha%' THEN 'alpha' WHEN cwd LIKE '%/beta/%' THEN 'beta' END AS project FROM calls""")
def x11(spark, sf):
    projects = loganalytics.known_projects(st.searches(spark, sf))
    return loganalytics.with_project(st.calls(spark, sf), projects).select("event_id", "project")


@query("x12_reference_relation", ctes(st.LOGS) + """
SELECT event_id, CASE WHEN collection LIKE '%-reference' THEN replace(collection, '-reference', '') END AS owner,
 CASE WHEN collection NOT LIKE '%-reference' THEN NULL WHEN project IS NULL THEN 'unknown_project' WHEN collection = project || '-reference' THEN 'own' ELSE 'foreign' END AS relation
FROM (SELECT *, CASE WHEN cwd LIKE '%/alpha%' THEN 'alpha' WHEN cwd LIKE '%/beta/%' THEN 'beta' END AS project FROM calls)""")
def x12(spark, sf):
    projects = loganalytics.known_projects(st.searches(spark, sf))
    c = loganalytics.with_project(st.calls(spark, sf), projects)
    return c.select("event_id", lf.reference_owner(F.col("collection")).alias("owner"),
                    lf.reference_relation(F.col("collection"), F.col("project")).alias("relation"))


CONFIG_SQL = """SELECT p_partkey, left(sha256('{"candidate_count_requested": 30, "embedding_context_size": ' || (p_size * 64)::VARCHAR || ', "embedding_model_name": "' || p_brand || '", "embedding_vector_dimension": 4096, "query_prefix": "Query: \\n", "reranker_context_size": null, "reranker_instruction": null, "reranker_model_name": "' || p_type || '", "truncation_limit_tokens": 4000}'), 16) AS fingerprint FROM part"""


@query("x13_config_fingerprint", CONFIG_SQL)
def x13(spark, sf):
    null = F.lit(None)
    fields = {
        "embedding_model_name": (F.col("p_brand"), True), "embedding_context_size": (F.col("p_size") * 64, False),
        "embedding_vector_dimension": (F.lit(4096), False), "query_prefix": (F.lit("Query: \n"), True),
        "truncation_limit_tokens": (F.lit(4000), False), "reranker_model_name": (F.col("p_type"), True),
        "reranker_context_size": (null.cast("int"), False), "reranker_instruction": (null.cast("string"), True),
        "candidate_count_requested": (F.lit(30), False),
    }
    return table(spark, sf, "part").select("p_partkey", lf.config_fingerprint(fields).alias("fingerprint"))


@query("x14_quantization", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Q8_0' WHEN 1 THEN 'Q4_K_M' WHEN 2 THEN 'BF16' WHEN 3 THEN 'F16' END AS quantization FROM part""")
def x14(spark, sf):
    p = F.col("p_partkey") % 5
    name = F.concat(F.col("p_brand"), F.when(p == 0, "-Q8_0").when(p == 1, "-q4_k_m").when(p == 2, ".bf16").when(p == 3, "-f16").otherwise("-f16-x"))
    return table(spark, sf, "part").select("p_partkey", lf.quantization(name).alias("quantization"))


@query("x15_shell_arguments", ctes(st.LOGS) + """
SELECT event_id, 0::INT AS pos, query, collection, CASE WHEN event_id % 3 = 0 THEN 'd_%' END AS document FROM searches
UNION ALL SELECT event_id, 1::INT, 'second ' || k::VARCHAR, 'other', NULL FROM searches WHERE event_id % 2 = 0""")
def x15(spark, sf):
    from sondeo.sources import transcripts
    s = st.searches(spark, sf)
    command = F.concat(
        F.lit("cd /tmp && lookup search \""), F.col("query"), F.lit("\" "), F.col("collection"),
        F.when(F.col("event_id") % 3 == 0, " --document 'd_%'").otherwise(""), F.lit(" 2>&1 | head -5\n"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/opt/bin/lookup search 'second "), F.col("k").cast("string"), F.lit("' other --verbose"))).otherwise("echo lookup search none none"),
    )
    parsed = s.select("event_id", F.posexplode(transcripts.search_arguments(command, "lookup")).alias("pos", "a"))
    return parsed.select("event_id", "pos", "a.query", "a.collection", "a.document")


@query("x16_timestamp_parse", "SELECT event_id, epoch_us(ts) AS us FROM events")
def x16(spark, sf):
    e = table(spark, sf, "events")
    body = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+00:00").otherwise("")
    return e.select("event_id", F.unix_micros(lf.parse_utc(F.concat(body, zone))).alias("us"))


@query("x17_first_line", f"""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '(empty result)' ELSE left(string_split(regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ''), chr(10))[1], 120) END AS line FROM documents""")
def x17(spark, sf):
    body = F.when(F.col("doc_id") % 10 == 0, F.lit(" \n\t")).otherwise(F.concat(F.lit("\n  "), F.col("text")))
    return text_table(spark, sf, "documents").select("doc_id", text.first_line(body).alias("line"))


@query("x18_keys_and_shares", """
SELECT l_suppkey, 'c|' || l_suppkey::VARCHAR || '|' || count(*)::VARCHAR AS chunk_key,
       format('{} / {} ({:.1f}%)', count(*) FILTER (l_returnflag = 'R'), count(*), 100.0::DOUBLE * count(*) FILTER (l_returnflag = 'R') / count(*)) AS share FROM lineitem GROUP BY 1""")
def x18(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("part"))
    return g.select("l_suppkey", lf.chunk_key(F.lit("c"), F.col("l_suppkey").cast("string"), F.col("n")).alias("chunk_key"),
                    lf.share_text(F.col("part"), F.col("n")).alias("share"))


@query("x19_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def x19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lf.content_hash(F.encode("text", "UTF-8")).alias("sha256"))


@query("u01_shared_ngrams", f"""
WITH t AS (SELECT conv_id, turn, {content_words_sql('text')} AS w FROM conversations), g AS (SELECT conv_id, turn, {ngrams_sql('w')} AS g FROM t)
SELECT a.conv_id, a.turn, len(list_intersect(a.g, b.g)) AS shared, array_to_string(list_sort(list_intersect(a.g, b.g)), ';') AS grams
FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def u01(spark, sf):
    c = table(spark, sf, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("summary"))
    pairs = c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("passage"), "summary")
    out = segments.shared_ngrams(pairs, "passage", "summary")
    return out.select("conv_id", "turn", F.size("shared").cast("long").alias("shared"), F.array_join("shared", ";").alias("grams"))


@query("u01_corpus_leakage", f"""
WITH t AS (SELECT doc_id AS id, {content_words_sql('text')} AS w FROM documents), b AS (SELECT item_id AS id, {content_words_sql('text')} AS w FROM benchmark),
tg AS (SELECT id, unnest({ngrams_sql('w')}) AS g FROM t), bg AS (SELECT id, unnest({ngrams_sql('w')}) AS g FROM b)
SELECT bg.id AS item_id, tg.id AS doc_id, count(*) AS shared FROM bg JOIN tg USING (g) GROUP BY ALL""")
def u01b(spark, sf):
    passages = text_table(spark, sf, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    summaries = table(spark, sf, "benchmark").select(F.col("item_id").alias("summary_id"), "text")
    out = segments.corpus_leakage(passages, summaries)
    return out.select(F.col("summary_id").alias("item_id"), F.col("passage_id").alias("doc_id"), "shared")


@query("u05_known_projects", ctes(st.LOGS) + """
SELECT DISTINCT regexp_replace(collection, '-(docs|reference)$', '') AS project FROM searches WHERE regexp_matches(collection, '-(docs|reference)$')""")
def u05(spark, sf):
    return loganalytics.known_projects(st.searches(spark, sf))
