"""Queries on sources, filters, chunk tables and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeo.catalog import standins as st
from sondeo.catalog.base import ctes, query, table, text_table
from sondeo.operators import chunking, filters, inventory
from sondeo.sources import corpus as corpus_source
from sondeo.sources import logs as log_source
from sondeo.sources import tables

KEY = "collection, document, chunk_index"

# -- sources and sinks ---------------------------------------------------------------------------------------------------

GLOBS = """globs(collection, pat) AS (VALUES ('web', '^https?/[^/]*[.]com/(?:.*/)?[^/]*[.]md$'), ('web', '^https?/(?:.*/)?[^/]*[0-4][.]md$'), ('all', '^.*[.]md$')),
files AS (SELECT page_id, replace(replace(split_part(split_part(url, '?', 1), '#', 1), '://', '/'), '/en/', '/venv/') || '.md' AS document, html FROM pages)"""


@query("s01_corpus_scan", ctes(GLOBS) + """
SELECT DISTINCT g.collection, f.page_id, f.document, sha256(f.html) AS sha256 FROM files f JOIN globs g ON regexp_matches(f.document, g.pat)
WHERE NOT list_contains(string_split(f.document, '/'), 'venv')""")
def s01(spark, sf):
    path = F.concat(F.replace(F.replace(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("://"), F.lit("/")), F.lit("/en/"), F.lit("/venv/")), F.lit(".md"))
    files = table(spark, sf, "pages").select("page_id", path.alias("document"), F.encode("html", "UTF-8").alias("bytes"))
    globs = spark.createDataFrame(
        [("web", "http*/*.com/**/*.md"), ("web", "http*/**/*[0-4].md"), ("all", "**.md")], "collection string, glob string"
    ).withColumn("regex", corpus_source.glob_regex(F.col("glob")))
    picked = corpus_source.select_files(files, globs)
    return picked.select("collection", "page_id", "document", F.sha2("bytes", 256).alias("sha256"))


@query("s02_manifest_expansion", """
SELECT 'm' || (page_id % 3)::VARCHAR AS collection, 'p' || page_id::VARCHAR || '/*.md' AS glob, '^p' || page_id::VARCHAR || '/[^/]*\\.md$' AS regex FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT 'n' || (page_id % 3)::VARCHAR, 'q' || page_id::VARCHAR || '/**/x?.md', '^q' || page_id::VARCHAR || '/(?:.*/)?x[^/]\\.md$' FROM pages WHERE page_id % 4 <> 0
UNION ALL SELECT 'solo' || page_id::VARCHAR, 'docs/*.md', '^docs/[^/]*\\.md$' FROM pages WHERE page_id % 4 = 0""")
def s02(spark, sf):
    p = F.col("page_id").cast("string")
    raw = table(spark, sf, "pages").select(
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("solo"), p)).alias("collection"),
        F.when(F.col("page_id") % 4 == 0, F.array(F.lit("docs/*.md"))).alias("include"),
        F.when(F.col("page_id") % 4 != 0, F.array(
            F.struct(F.concat(F.lit("m"), (F.col("page_id") % 3).cast("string")).alias("name"), F.array(F.concat(F.lit("p"), p, F.lit("/*.md"))).alias("include")),
            F.struct(F.concat(F.lit("n"), (F.col("page_id") % 3).cast("string")).alias("name"), F.array(F.concat(F.lit("q"), p, F.lit("/**/x?.md"))).alias("include")),
        )).alias("collections"),
    )
    return corpus_source.expand_manifest(raw)


@query("s03_sidecar_read", ctes(st.CHUNKS) + f"""
SELECT {KEY}, (count(*) OVER (PARTITION BY collection, document))::INT AS total_chunks, content FROM chunks""")
def s03(spark, sf):
    return tables.sidecar_rows(tables.sidecar_records(st.chunks(spark, sf)))


@query("s04_sidecar_write", ctes(st.CHUNKS) + """
SELECT collection, document, count(*) AS n, string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) AS indexes,
       sha256(string_agg(content, '|' ORDER BY chunk_index)) AS digest FROM chunks GROUP BY ALL""")
def s04(spark, sf):
    rec = tables.sidecar_records(st.chunks(spark, sf))
    return rec.select(
        "collection", "document", F.size("chunks").cast("long").alias("n"),
        F.array_join(F.transform("chunks", lambda c: c["index"].cast("string")), ",").alias("indexes"),
        F.sha2(F.array_join("chunks.content", "|").cast("binary"), 256).alias("digest"),
    )


INCOMING = f"""incoming AS (SELECT collection, document, chunk_index, 'new: ' || content AS content FROM chunks WHERE conv_id % 3 = 0 AND chunk_index < 2)"""


@query("s05_replace_documents", ctes(st.CHUNKS, INCOMING) + f"""
SELECT {KEY}, content FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.collection = c.collection AND i.document = c.document)
UNION ALL SELECT {KEY}, content FROM incoming""")
def s05(spark, sf):
    c = st.chunks(spark, sf).select("collection", "document", "chunk_index", "content", "conv_id")
    incoming = c.filter("conv_id % 3 = 0 AND chunk_index < 2").withColumn("content", F.concat(F.lit("new: "), F.col("content"))).drop("conv_id")
    return tables.replace_documents(c.drop("conv_id"), incoming)


DELETE_KEYS = """keys AS (SELECT DISTINCT collection, CASE WHEN collection = 'col4' THEN NULL ELSE document END AS document FROM chunks WHERE collection = 'col4' OR conv_id % 6 = 1)"""


def _delete_keys(c):
    whole = F.col("collection") == "col4"
    return c.filter(whole | (F.col("conv_id") % 6 == 1)).select(
        "collection", F.when(~whole, F.col("document")).alias("document")).distinct()


@query("s06_delete_documents", ctes(st.CHUNKS, DELETE_KEYS) + f"""
SELECT {KEY} FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.collection = c.collection AND (k.document IS NULL OR k.document = c.document))""")
def s06(spark, sf):
    c = st.chunks(spark, sf)
    return tables.delete_documents(c, _delete_keys(c)).select("collection", "document", "chunk_index")


@query("s06_deleted_counts", ctes(st.CHUNKS, DELETE_KEYS) + """
SELECT collection, count(*) AS deleted FROM chunks c WHERE EXISTS (SELECT 1 FROM keys k WHERE k.collection = c.collection AND (k.document IS NULL OR k.document = c.document)) GROUP BY 1""")
def s06b(spark, sf):
    c = st.chunks(spark, sf)
    return tables.deleted_counts(c, _delete_keys(c))


@query("s07_jsonl_read", ctes(st.LOGS) + """
SELECT expand_id, collection, document, chunk_index, duration_ms, ts FROM expands""")
def s07(spark, sf):
    e = st.expands(spark, sf)
    stamped = e.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    lines = stamped.select(F.explode(F.array(F.to_json(F.struct(*stamped.columns)), F.lit("  "))).alias("value"))
    parsed = log_source.with_time(log_source.parse_lines(lines, log_source.EXPAND_LOG))
    return parsed.select("expand_id", "collection", "document", "chunk_index", "duration_ms", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("s08_search_log_record", ctes(st.LOGS) + """
SELECT s.search_id, s.query, s.collection, coalesce(h.hit_count, 0) AS hit_count, h.listing
FROM searches s LEFT JOIN (SELECT search_id, count(*)::INT AS hit_count, string_agg(rank::VARCHAR || ':' || document || '#' || chunk_index::VARCHAR, ' ' ORDER BY rank) AS listing FROM hits GROUP BY 1) h USING (search_id)""")
def s08(spark, sf):
    rec = log_source.search_records(st.searches(spark, sf), st.hits(spark, sf))
    text = F.transform("hits", lambda h: F.concat(h["rank"].cast("string"), F.lit(":"), h["document"], F.lit("#"), h["chunk_index"].cast("string")))
    return rec.select("search_id", "query", "collection", "hit_count", F.when(F.col("hit_count") > 0, F.array_join(text, " ")).alias("listing"))


EXPANDED = """anchors AS (SELECT collection, document, chunk_index AS anchor_index, (conv_id % 4)::INT AS before, (conv_id % 13)::INT AS after, conv_id FROM chunks WHERE (conv_id + chunk_index) % 3 = 0)"""


def _anchors(c):
    return c.filter("(conv_id + chunk_index) % 3 = 0").select(
        "collection", "document", "chunk_index", (F.col("conv_id") % 4).cast("int").alias("before"), (F.col("conv_id") % 13).cast("int").alias("after"))


@query("s09_expand_log_record", ctes(st.CHUNKS, EXPANDED) + """
SELECT a.collection, a.document, a.anchor_index AS chunk_index, a.before, a.after, count(*) AS chunks_returned
FROM anchors a JOIN chunks c ON c.collection = a.collection AND c.document = a.document AND c.chunk_index BETWEEN a.anchor_index - a.before AND a.anchor_index + least(a.after, 10)
GROUP BY ALL""")
def s09(spark, sf):
    c = st.chunks(spark, sf)
    got = chunking.expand_anchors(_anchors(c), c)
    return got.groupBy("collection", "document", "anchor_index", "before", "after").agg(F.count("*").alias("chunks_returned")).withColumnRenamed("anchor_index", "chunk_index")


@query("s15_collection_upsert", ctes(st.CHUNKS) + """,
stored AS (SELECT DISTINCT collection AS name, 1::BIGINT AS doc_count, 1::BIGINT AS chunk_count, 'old' AS notes FROM chunks WHERE conv_id % 2 = 0 UNION ALL SELECT 'attic', 7, 70, 'kept'),
stats AS (SELECT collection AS name, count(DISTINCT document) AS doc_count, count(*) AS chunk_count, 'new' AS notes FROM chunks WHERE conv_id % 10 < 7 GROUP BY 1)
SELECT name, coalesce(n.doc_count, o.doc_count) AS doc_count, coalesce(n.chunk_count, o.chunk_count) AS chunk_count, coalesce(n.notes, o.notes) AS notes
FROM stored o FULL OUTER JOIN stats n USING (name)""".replace("WITH ", "", 0))
def s15(spark, sf):
    c = st.chunks(spark, sf)
    old = c.filter("conv_id % 2 = 0").select(F.col("collection").alias("name")).distinct().select(
        "name", F.lit(1).cast("long").alias("doc_count"), F.lit(1).cast("long").alias("chunk_count"), F.lit("old").alias("notes"))
    attic = spark.createDataFrame([("attic", 7, 70, "kept")], old.schema)
    stats = tables.collection_stats(c.filter("conv_id % 10 < 7")).withColumn("notes", F.lit("new"))
    return tables.upsert_collections(old.unionByName(attic), stats)


# -- filters -------------------------------------------------------------------------------------------------------------

PATTERNS = ["conv_1%", "conv_12.md", "conv_1_.md", "conv_1_%", "%"]
PATTERN_SQL = "patterns(pattern) AS (VALUES " + ", ".join(f"('{p}')" for p in PATTERNS) + ")"
MATCH_SQL = "(CASE WHEN contains(pattern, '%') THEN document LIKE pattern ELSE document = pattern END)"


def _per_pattern(spark, sf, apply):
    c = st.chunks(spark, sf)
    parts = [apply(c, p).select(F.lit(p).alias("pattern"), "collection", "document", "chunk_index") for p in PATTERNS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("f01_document_include", ctes(st.CHUNKS, PATTERN_SQL) + f"SELECT pattern, {KEY} FROM chunks, patterns WHERE {MATCH_SQL}")
def f01(spark, sf):
    return _per_pattern(spark, sf, filters.include_documents)


@query("f02_document_exclude", ctes(st.CHUNKS, PATTERN_SQL) + f"SELECT pattern, {KEY} FROM chunks, patterns WHERE NOT {MATCH_SQL}")
def f02(spark, sf):
    return _per_pattern(spark, sf, filters.exclude_documents)


@query("f03_substring_filter", """
SELECT page_id, url FROM pages WHERE url ILIKE '%EXAMPLE.C_M%' UNION ALL SELECT page_id, url FROM pages WHERE url ILIKE '%Net/%2%'""")
def f03(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return filters.containing(p, "url", "EXAMPLE.C_M").unionByName(filters.containing(p, "url", "Net/%2"))


@query("f04_unknown_collections", ctes(st.CHUNKS) + """
SELECT DISTINCT 'col' || (item_id % 15)::VARCHAR AS collection FROM benchmark WHERE 'col' || (item_id % 15)::VARCHAR NOT IN (SELECT collection FROM chunks)""")
def f04(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.concat(F.lit("col"), (F.col("item_id") % 15).cast("string")).alias("collection"))
    return filters.unknown_collections(asked, st.chunks(spark, sf))


@query("f05_time_window", """
SELECT event_id, 'closed' AS kind FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'
UNION ALL SELECT event_id, 'since' FROM events WHERE ts >= TIMESTAMP '2024-01-20' UNION ALL SELECT event_id, 'open' FROM events""")
def f05(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pick = lambda kind, *b: filters.in_window(e, "ts", *b).select("event_id", F.lit(kind).alias("kind"))
    return pick("closed", "2024-01-05 00:00:00", "2024-01-09 12:00:00").unionByName(pick("since", "2024-01-20")).unionByName(pick("open"))


@query("f06_positive_scores", "SELECT l_orderkey, l_linenumber, round(l_discount - 0.05, 4) AS score FROM lineitem WHERE round(l_discount - 0.05, 4) > 0")
def f06(spark, sf):
    h = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") - 0.05, 4).alias("score"))
    return filters.positive_scores(h)


@query("f07_score_threshold", """
SELECT l_orderkey, l_linenumber, 'dense' AS mode FROM lineitem WHERE l_discount >= 0.05
UNION ALL SELECT l_orderkey, l_linenumber, 'hybrid' FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'cc at 0' FROM lineitem""")
def f07(spark, sf):
    h = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("score"))
    part = lambda name, mode, t: filters.above_threshold(h, mode, t).select("l_orderkey", "l_linenumber", F.lit(name).alias("mode"))
    return part("dense", "dense", 0.05).unionByName(part("hybrid", "hybrid", 0.05)).unionByName(part("cc at 0", "cc", 0.0))


@query("f08_encoder_input", "SELECT doc_id, length('search_document: ' || left(text, 12000)) AS size, sha256('search_document: ' || left(text, 12000)) AS digest FROM documents")
def f08(spark, sf):
    prepared = filters.encoder_input(F.col("text"), "search_document: ")
    return table(spark, sf, "documents").select(
        "doc_id", F.length(prepared).cast("long").alias("size"), F.sha2(prepared.cast("binary"), 256).alias("digest"))


@query("f09_null_vectors", ctes(st.VECTORS) + """
SELECT collection, document, count(*) AS skipped FROM vec_chunks WHERE vec_id % 5 IN (1, 2) GROUP BY ALL""")
def f09(spark, sf):
    c = st.vec_chunks(spark, sf).withColumn("embedding", F.expr(
        "CASE vec_id % 5 WHEN 1 THEN transform(embedding, x -> CAST(NULL AS FLOAT)) WHEN 2 THEN CAST(array() AS ARRAY<FLOAT>) "
        "WHEN 3 THEN transform(embedding, (x, i) -> IF(i = 0, x, NULL)) ELSE embedding END"))
    return filters.split_null_vectors(c)[1]


@query("f11_sampled_log", ctes(st.LOGS) + "SELECT search_id, hit_count FROM searches WHERE ts >= TIMESTAMP '2024-01-11' AND hit_count > 0")
def f11(spark, sf):
    return filters.sampled_log(st.searches(spark, sf), "2024-01-11").select("search_id", "hit_count")


KNOWN = ", ".join(f"'{c}'" for c in filters.ERROR_CODES)


@query("f12_known_errors", ctes(st.LOGS) + f"""
SELECT msg, server, code, 'all' AS scope FROM errors WHERE code IN ({KNOWN})
UNION ALL SELECT msg, server, code, 'today' FROM errors WHERE code IN ({KNOWN}) AND ts >= TIMESTAMP '2024-01-19 23:00:00'""")
def f12(spark, sf):
    e = st.errors(spark, sf)
    part = lambda d, s: d.select("msg", "server", "code", F.lit(s).alias("scope"))
    today = filters.known_errors(e, "2024-01-20 15:30:00", "Europe/Berlin")
    return part(filters.known_errors(e), "all").unionByName(part(today, "today"))


@query("f13_version_default", ctes(st.LOGS) + "SELECT search_id, coalesce(nullif(code_version, ''), 'unversioned') AS version FROM searches")
def f13(spark, sf):
    return filters.with_version(st.searches(spark, sf)).select("search_id", "version")


# -- chunks --------------------------------------------------------------------------------------------------------------

@query("c01_corpus_chunks")
def c01(spark, sf):
    cut = chunking.chunk_documents(st.corpus(spark, sf, text_table))
    return cut.select("collection", "document", "chunk_index", "total_chunks", F.length("content").alias("size"),
                      F.md5("content").alias("digest"))


@query("c02_enriched_chunks", """
SELECT 'x' AS collection, doc_id::VARCHAR AS document, (unnest(range(len(string_split(text, chr(10))))))::INT AS chunk_index,
       len(string_split(text, chr(10)))::INT AS total_chunks, unnest(string_split(text, chr(10))) AS content FROM documents""")
def c02(spark, sf):
    d = table(spark, sf, "documents").select(
        F.lit("x").alias("collection"), F.col("doc_id").cast("string").alias("document"), F.split("text", "\n", -1).alias("parts"))
    return chunking.enrich(d, "parts")


@query("c03_chunk_stats", ctes(st.CHUNKS) + """
SELECT collection, document, count(*) AS num_chunks, (sum(length(content)) // count(*))::BIGINT AS avg_chunk_size,
       min(length(content))::INT AS min_chunk, max(length(content))::INT AS max_chunk FROM chunks GROUP BY GROUPING SETS ((collection, document), ())""")
def c03(spark, sf):
    return chunking.chunk_stats(st.chunks(spark, sf))


@query("c04_size_histogram", """
SELECT b.bucket, count(d.bucket) AS count, round(100.0 * count(d.bucket) / (SELECT count(*) FROM documents), 1) AS percent
FROM (VALUES ('0-500'), ('500-1000'), ('1000-1500'), ('1500-2000'), ('2000+')) b(bucket)
LEFT JOIN (SELECT CASE WHEN length(text) < 500 THEN '0-500' WHEN length(text) < 1000 THEN '500-1000' WHEN length(text) < 1500 THEN '1000-1500'
  WHEN length(text) < 2000 THEN '1500-2000' ELSE '2000+' END AS bucket FROM documents) d USING (bucket) GROUP BY 1""")
def c04(spark, sf):
    return chunking.size_histogram(table(spark, sf, "documents").select(F.col("text").alias("content")))


# Neighbouring turns share no text, so each pair gets a constructed overlap: the last m characters of the turn open the next one.
PAIRS = """pairs AS (
  SELECT collection, document, chunk_index, text1, right(text1, (conv_id * 13 + chunk_index * 37) % 450) || text2 AS text2
  FROM (SELECT *, content AS text1, lead(content) OVER (PARTITION BY collection, document ORDER BY chunk_index) AS text2 FROM chunks) WHERE text2 IS NOT NULL)"""


def _pairs(spark, sf):
    p = chunking.neighbour_pairs(st.chunks(spark, sf))
    conv = F.regexp_extract("document", r"(\d+)", 1).cast("int")
    return p.withColumn("text2", F.concat(F.right("text1", (conv * 13 + F.col("chunk_index") * 37) % 450), F.col("text2")))


OVERLAP_SQL = "coalesce(list_max(list_filter(range(1, least(length(text1), length(text2), {cap}) + 1), lambda n: right(text1, n) = left(text2, n))), 0)::INT"


@query("c05_neighbour_overlap", ctes(st.CHUNKS, PAIRS) + f"SELECT {KEY}, {OVERLAP_SQL.format(cap=400)} AS overlap FROM pairs")
def c05(spark, sf):
    return chunking.overlaps(_pairs(spark, sf)).select("collection", "document", "chunk_index", "overlap")


@query("c06_tolerant_overlap")
def c06(spark, sf):
    spaced = _pairs(spark, sf).withColumn("text2", F.regexp_replace("text2", " ", "  "))
    return spaced.select("collection", "document", "chunk_index", chunking.tolerant_overlap(2000)("text1", "text2").alias("overlap"))


VARIANTS = f"measured AS (SELECT {KEY}, {OVERLAP_SQL.format(cap=300)} AS a, {OVERLAP_SQL.format(cap=2000)} AS b FROM pairs)"


def _measured(spark, sf):
    p = chunking.overlaps(chunking.overlaps(_pairs(spark, sf), 300, "a"), 2000, "b")
    return p.select("collection", "document", "chunk_index", "a", "b")


@query("c07_overlap_summary", ctes(st.CHUNKS, PAIRS, VARIANTS) + """
SELECT collection, variant, count(*) AS n, round(100.0 * count(*) FILTER (v = 0) / count(*), 1) AS zero_pct, min(v) AS min, max(v) AS max,
       round(avg(v), 1) AS mean, median(v) AS median, count(*) FILTER (a <> b) AS disagreeing, count(*) FILTER (a = 0) AS residual
FROM (SELECT collection, 'a' AS variant, a AS v, a, b FROM measured UNION ALL SELECT collection, 'b', b, a, b FROM measured) GROUP BY ALL""")
def c07(spark, sf):
    return chunking.overlap_summary(_measured(spark, sf), ["a", "b"], "b", "a")


def _spaced(spark, sf):
    """Exact 300, exact 2,000 and tolerant 2,000 on the pairs whose right texts have wider blanks."""
    spaced = _pairs(spark, sf).withColumn("text2", F.regexp_replace("text2", " ", "  "))
    return chunking.overlaps(chunking.overlaps(spaced, 300, "a"), 2000, "b").withColumn("c", chunking.tolerant_overlap(2000)("text1", "text2"))


@query("c07_variant_summary")
def c07c(spark, sf):
    return chunking.overlap_summary(_spaced(spark, sf), ["a", "b", "c"], "b", "c")


@query("c07_unmatched_pairs")
def c07d(spark, sf):
    return chunking.unmatched_pairs(_spaced(spark, sf), "b", "c")


@query("c07_overlap_extremes", ctes(st.CHUNKS, PAIRS, VARIANTS) + """
SELECT collection, min(b) AS min_overlap, first(document ORDER BY b, document, chunk_index) AS min_document, first(chunk_index ORDER BY b, document, chunk_index) AS min_chunk_index,
       max(b) AS max_overlap, first(document ORDER BY b DESC, document, chunk_index) AS max_document, first(chunk_index ORDER BY b DESC, document, chunk_index) AS max_chunk_index
FROM measured WHERE b > 0 GROUP BY 1""")
def c07b(spark, sf):
    return chunking.overlap_extremes(_measured(spark, sf), "b")


@query("c08_neighbour_expansion", ctes(st.CHUNKS, EXPANDED) + """
SELECT a.collection, a.document, a.anchor_index, c.chunk_index, c.content FROM anchors a JOIN chunks c
ON c.collection = a.collection AND c.document = a.document AND c.chunk_index BETWEEN a.anchor_index - a.before AND a.anchor_index + least(a.after, 10)""")
def c08(spark, sf):
    c = st.chunks(spark, sf)
    return chunking.expand_anchors(_anchors(c), c).select("collection", "document", "anchor_index", "chunk_index", "content")


@query("c09_merged_expansion")
def c09(spark, sf):
    c = st.chunks(spark, sf)
    return chunking.merge_expanded(chunking.expand_anchors(_anchors(c), c), ["collection", "document", "anchor_index"])


WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"



def norm_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS}', ' ', 'g'))"


COVERAGE = f"""texts AS (SELECT c.*, {norm_sql('c.content')} AS one, {norm_sql("c.content || ' ' || n.content")} AS two
  FROM chunks c LEFT JOIN chunks n ON n.collection = c.collection AND n.document = c.document AND n.chunk_index = c.chunk_index + 1),
found AS (SELECT q.quote_id, min(t.chunk_index) FILTER (contains(t.one, {norm_sql('q.quote')})) AS s, min(t.chunk_index) FILTER (contains(t.two, {norm_sql('q.quote')})) AS b, count(t.document) AS seen
  FROM quotes q LEFT JOIN texts t ON t.collection = q.collection AND t.document = q.document GROUP BY 1),
coverage AS (SELECT quote_id, collection, document, chunk_index AS expected_chunk_index, CASE WHEN s IS NOT NULL THEN 'single' WHEN b IS NOT NULL THEN 'boundary' ELSE 'missing' END AS status,
  coalesce(s, b) AS matched_chunk_index, CASE WHEN s IS NOT NULL THEN s = chunk_index END AS index_match, seen > 0 AS doc_found FROM quotes JOIN found USING (quote_id))"""


@query("c10_quote_coverage", ctes(st.CHUNKS, st.QUOTES, COVERAGE) + "SELECT * FROM coverage")
def c10(spark, sf):
    return chunking.quote_coverage(st.quotes(spark, sf), st.chunks(spark, sf))


@query("c11_coverage_summary", ctes(st.CHUNKS, st.QUOTES, COVERAGE) + """
SELECT s.status, count(c.status) AS count, count(*) FILTER (NOT index_match) AS index_mismatches, round(count(c.status) / (SELECT count(*) FROM coverage), 4) AS share
FROM (VALUES ('single'), ('boundary'), ('missing')) s(status) LEFT JOIN coverage c USING (status) GROUP BY 1""")
def c11(spark, sf):
    return chunking.coverage_summary(chunking.quote_coverage(st.quotes(spark, sf), st.chunks(spark, sf)))


@query("c12_drifted_quotes", ctes(st.CHUNKS, st.QUOTES) + """
SELECT q.quote_id, q.chunk_index FROM quotes q LEFT JOIN chunks c USING (collection, document, chunk_index) WHERE NOT coalesce(c.content LIKE '%' || q.quote || '%', false)""")
def c12(spark, sf):
    return chunking.drifted_quotes(st.quotes(spark, sf), st.chunks(spark, sf)).select("quote_id", "chunk_index")


@query("c13_redundant_hits", """
WITH h AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS document, l_linenumber AS chunk_index FROM lineitem)
SELECT a.query_id, a.document, a.chunk_index FROM h a JOIN h b ON a.query_id = b.query_id AND a.document = b.document AND a.chunk_index = b.chunk_index + 1""")
def c13(spark, sf):
    h = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), F.lit("p").alias("collection"), F.col("l_partkey").alias("document"),
        F.col("l_linenumber").alias("chunk_index")).distinct().withColumn("rank", F.lit(0))
    return chunking.redundant_hits(h).select("query_id", "document", "chunk_index")


# -- inventory -----------------------------------------------------------------------------------------------------------

@query("a01_collection_counts", "SELECT source AS collection, count(*) AS chunks FROM documents WHERE source ILIKE '%SRC1%' GROUP BY 1")
def a01(spark, sf):
    return inventory.collections(st.corpus(spark, sf), "SRC1")


@query("a02_document_counts", ctes(st.CHUNKS) + """
SELECT collection, document, count(*) AS chunks FROM chunks WHERE collection = 'col3' AND document LIKE 'conv_%' AND document NOT LIKE '%13%' AND document ILIKE '%3.MD%' GROUP BY ALL""")
def a02(spark, sf):
    return inventory.documents(st.chunks(spark, sf), "col3", "conv_%", "%13%", "3.MD")


@query("a03_progress", ctes(st.CHUNKS) + """
SELECT collection, document, count(*) AS done, max(total_chunks)::BIGINT AS total, 100.0 * count(*) / max(total_chunks) AS percent,
       CASE WHEN count(*) >= max(total_chunks) THEN 'done' ELSE 'in-progress' END AS status, count(*) = max(total_chunks) AS complete FROM chunks GROUP BY ALL""")
def a03(spark, sf):
    return inventory.progress(st.chunks(spark, sf))


RUN = """, run AS (SELECT collection, document, CASE WHEN conv_id % 9 = 2 THEN 'failed' END AS error FROM chunks GROUP BY ALL UNION ALL SELECT 'col0', 'empty.md', NULL),
per_file AS (SELECT r.collection, r.document, count(c.content) AS chunks, coalesce(sum(length(c.content)) // nullif(count(c.content), 0), 0)::BIGINT AS avg_chunk_size, (any_value(error) IS NOT NULL) AS failed
  FROM run r LEFT JOIN chunks c USING (collection, document) GROUP BY ALL) """


def _run_stats(spark, sf):
    c = st.chunks(spark, sf)
    run = c.select("collection", "document", F.when(F.col("conv_id") % 9 == 2, "failed").alias("error")).distinct()
    run = run.unionByName(spark.createDataFrame([("col0", "empty.md", None)], run.schema))
    return inventory.index_run_stats(run, c)


@query("a38_index_run_files", ctes(st.CHUNKS) + RUN + "SELECT * FROM per_file")
def a38(spark, sf):
    return _run_stats(spark, sf)


@query("a38_index_run_summary", ctes(st.CHUNKS) + RUN + """
SELECT count(*) FILTER (chunks > 0 AND NOT failed) AS files, (sum(chunks) FILTER (NOT failed))::BIGINT AS chunks, count(*) FILTER (failed) AS errors FROM per_file""")
def a38b(spark, sf):
    return inventory.index_run_summary(_run_stats(spark, sf))
