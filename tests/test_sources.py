"""Readers and writers on real files."""

import json

import pytest

from sondeo.sources import corpus, evalsets, logs, tables, transcripts

TOOL = "lookup"


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body, encoding="utf-8")


def test_corpus_scan(spark, tmp_path):
    root = tmp_path / "proj"
    for rel in ("docs/a.md", "docs/sub/b.md", "docs/c.txt", "venv/d.md", "docs/.git/e.md", ".claude/worktrees/x/f.md", ".claude/g.md", "top.md", "docs/{odd}+1.md"):
        write(root / rel, f"text of {rel}")
    write(tmp_path / "m.json", json.dumps({"collections": [{"name": "docs", "include": ["docs/**/*.md", "docs/*.md"]}, {"name": "all", "include": ["**/*.md"]}]}))
    globs = corpus.manifest_globs(spark, str(tmp_path / "m.json"))
    rows = corpus.hashed(corpus.scan(spark, str(root), globs, hidden=[".claude"])).collect()
    got = sorted((r.collection, r.document) for r in rows)
    assert got == [("all", ".claude/g.md"), ("all", "docs/a.md"), ("all", "docs/sub/b.md"), ("all", "docs/{odd}+1.md"), ("all", "top.md"),
                   ("docs", "docs/a.md"), ("docs", "docs/sub/b.md"), ("docs", "docs/{odd}+1.md")]
    assert {r.content for r in rows if r.document == "top.md"} == {"text of top.md"}


def test_manifest_rules(spark, tmp_path):
    for name, body in {"one": {"collection": "c", "include": ["*.md"]}, "empty": {"collections": []}, "nameless": {"collections": [{"name": "", "include": []}]}}.items():
        write(tmp_path / f"{name}.json", json.dumps(body))
    schema = "collection string, include array<string>, collections array<struct<name: string, include: array<string>>>"
    raw = spark.read.schema(schema).json(str(tmp_path))
    assert sorted(r.problem for r in corpus.manifest_problems(raw).collect()) == ["collection name is empty", "collections is empty", "include is empty"]


def test_sidecars_round_trip(spark, tmp_path):
    rows = [("c", "d", i, 3, f"t{i}") for i in (2, 0, 1)] + [("c", "e", 0, 1, "ü")]
    df = spark.createDataFrame(rows, "collection string, document string, chunk_index int, total_chunks int, content string")
    path = str(tmp_path / "side")
    tables.write_sidecars(df.coalesce(1), path)
    assert sorted(map(tuple, tables.read_sidecars(spark, path).collect())) == sorted(rows)


def test_sidecars_of_both_layouts(spark, tmp_path):
    def record(document, n):
        return {"collection": "c", "document": document, "chunks": [{"index": i, "content": f'{document} {{"é"}}\n  {i}\u2028'} for i in range(n)]}

    write(tmp_path / "s/a.json", json.dumps(record("a", 3), indent=2, ensure_ascii=False))
    write(tmp_path / "s/b.json", "\n" + json.dumps(record("b", 40), indent=2).replace("\n", "\r\n") + "\n\n")
    write(tmp_path / "s/many.json", "\n".join(json.dumps(record(f"m{k}", k % 3)) for k in range(50)) + "\n\n")
    write(tmp_path / "s/array.json", "[\n" + ",\n".join(json.dumps(record(f"r{k}", 2)) for k in range(3)) + "\n]")
    write(tmp_path / "s/empty.json", "")
    made = [record("a", 3), record("b", 40), *[record(f"m{k}", k % 3) for k in range(50)], *[record(f"r{k}", 2) for k in range(3)]]
    want = sorted(("c", r["document"], c["index"], len(r["chunks"]), c["content"]) for r in made for c in r["chunks"])
    assert sorted(map(tuple, tables.read_sidecars(spark, str(tmp_path / "s")).collect())) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert sorted(map(tuple, tables.read_sidecars(spark, str(tmp_path / "s")).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    line = json.dumps(record("x", 1))
    bad = {"cut": json.dumps(record("x", 1), indent=2)[:-3], "line": f"{line}\n{line[:-4]}", "after": f"{line}\n{line} {line}", "first": f"{line[:-4]}\n{line}",
           "shape": line.replace('"index": 0', '"index": "no"'), "keys": '{"collection": "c", "document": "d"}', "two": json.dumps(record("x", 1), indent=2) * 2}
    for name, body in bad.items():
        write(tmp_path / f"bad_{name}.json", body)
        with pytest.raises(Exception, match="not a sidecar record"):
            tables.read_sidecars(spark, str(tmp_path / f"bad_{name}.json")).collect()


def test_replacing_documents_in_a_table(spark, tmp_path):
    schema = "collection string, document string, chunk_index int, content string"
    target, stage = str(tmp_path / "t"), str(tmp_path / "s")
    tables.write_replaced(spark.createDataFrame([("a", "x", 0, "1"), ("a", "y", 0, "2"), ("b", "z", 0, "3")], schema), target, stage)
    tables.write_replaced(spark.createDataFrame([("a", "x", 0, "new"), ("a", "x", 1, "more")], schema), target, stage)
    got = sorted(map(tuple, spark.read.schema(schema).parquet(target).select("collection", "document", "chunk_index", "content").collect()))
    assert got == [("a", "x", 0, "new"), ("a", "x", 1, "more"), ("a", "y", 0, "2"), ("b", "z", 0, "3")]


def test_jsonl_logs(spark, tmp_path):
    write(tmp_path / "e.jsonl", '{"ts": "2026-09-18T17:24:45+00:00", "expand_id": "e1", "collection": "c", "document": "d", "chunk_index": 0, "before": 0, "after": 1}\n\n  \n')
    assert logs.read_jsonl(spark, str(tmp_path / "e.jsonl"), logs.EXPAND_LOG).count() == 1
    assert logs.read_jsonl(spark, str(tmp_path / "missing.jsonl"), logs.EXPAND_LOG).count() == 0
    write(tmp_path / "bad.jsonl", '{"ts": "x", "expand_id": "e1"}\n{"ts": "y", "expand\n')
    with pytest.raises(Exception, match="not a JSON line"):
        logs.read_jsonl(spark, str(tmp_path / "bad.jsonl"), logs.EXPAND_LOG).collect()
    write(tmp_path / "err.jsonl", '{"ts": "t", "server": "s", "code": "busy", "msg": "m", "pid": 7, "who": "x"}\n')
    row = logs.read_errors(spark, str(tmp_path / "err.jsonl")).first()
    assert (row.code, row.extra) == ("busy", {"pid": "7", "who": "x"})


def test_search_log_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("s1", "q"), ("s2", "r")], "search_id string, query string")
    h = spark.createDataFrame([("s1", 2, "b", 0, 0.5), ("s1", 1, "a", 3, 0.9)], "search_id string, rank int, document string, chunk_index int, score double")
    path = str(tmp_path / "log")
    logs.append_jsonl(logs.search_records(s, h), path)
    logs.append_jsonl(logs.search_records(s.limit(0), h), path)
    got = {r.search_id: r for r in logs.read_jsonl(spark, path, logs.SEARCH_LOG).collect()}
    assert [x["rank"] for x in got["s1"].hits] == [1, 2] and got["s1"].hit_count == 2 and got["s2"].hits == []


def test_query_sets(spark, tmp_path):
    entry = {"query": "q", "type": "t", "expected_documents": ["d"], "expected_chunks": [{"document": "d", "chunk_index": 1, "identifying_quote": "x"}] * 2}
    write(tmp_path / "a.json", json.dumps({"queries": [entry, entry]}, indent=1))
    write(tmp_path / "b.json", json.dumps([entry]))
    q = evalsets.query_table(evalsets.read_query_sets(spark, str(tmp_path)))
    assert sorted(r.query_id for r in q.collect()) == ["a.json#1", "a.json#2", "b.json#1"]
    assert evalsets.expected_chunks(q).count() == 6 and evalsets.expected_documents(q).count() == 3


def test_judgment_files(spark, tmp_path):
    write(tmp_path / "N01.txt", "# header\nN01-c01 2 a3,a1\nN01-c02 0\nshort\nN01-c01 1\n")
    write(tmp_path / "N02.txt", "N01-c02 2 a1\n")
    got = {r.id: (r.grade, r.aspects) for r in evalsets.read_judgments(spark, str(tmp_path)).collect()}
    assert got == {"N01-c01": (1, []), "N01-c02": (2, ["a1"])}


def test_segmentation_artifacts(spark, tmp_path):
    write(tmp_path / "b.json", json.dumps({"document": "d", "model": "m", "themes": [{"id": "t1", "label": "secret", "need": "n", "spans": [{"line_start": 1, "line_end": 4}]}]}, indent=1))
    themes = evalsets.themes(evalsets.read_artifacts(spark, str(tmp_path / "b.json"), evalsets.PASS_B))
    assert evalsets.theme_spans(themes).collect()[0][1:] == ("t1", 1, 4)
    assert evalsets.spans_only(themes).columns == ["document", "id", "spans"]


def message(kind, when, content, session="s", cwd="/w"):
    return json.dumps({"type": kind, "timestamp": when, "sessionId": session, "cwd": cwd, "message": {"role": kind, "content": content}})


def use(uid, command=None, name="Bash", **inputs):
    return {"type": "tool_use", "id": uid, "name": name, "input": {"command": command, **inputs} if command is not None else inputs}


def test_transcripts(spark, tmp_path):
    lines = [
        message("user", "t0", "  please search  "),
        message("assistant", "t1", [{"type": "text", "text": "first"}, {"type": "text", "text": "second"},
                                    use("u1", f"cd /x; {TOOL} search \"a b\" col --document 'D_%' 2>&1 | head; /bin/{TOOL} search 'c d' other --exclude z --flag\necho {TOOL} search no no")]),
        message("user", "t2", [{"type": "tool_result", "tool_use_id": "u1", "content": [{"type": "text", "text": "out"}, {"type": "text", "text": "put"}]}]),
        "not json tool_use_id",
        message("assistant", "t3", [use("u2", name="Read", file_path="/p/tool-results/r.txt"), use("u3", "cat /p/tool-results/s.txt")]),
        message("assistant", "t4", [use("u4", f"{TOOL} search 'unbalanced")]),
        message("user", "t5", "later question"),
        message("assistant", "t6", [use("u5", f"time {TOOL} search lone")]),
    ]
    write(tmp_path / "s.jsonl", "\n".join(lines))
    scan = transcripts.read_lines(spark, str(tmp_path / "s.jsonl"))
    calls = sorted(map(tuple, transcripts.tool_calls(scan, TOOL).select("tool_use_id", "query", "collection", "document", "exclude", "tool_use_ts", "result_ts", "result_text").collect()), key=str)
    assert calls == [("u1", "a b", "col", "D_%", None, "t1", "t2", "out put"), ("u1", "c d", "other", None, "z", "t1", "t2", "out put"), ("u5", "lone", None, None, None, "t6", None, "")]
    assert sorted(r.text for r in transcripts.readbacks(scan).collect()) == ["/p/tool-results/r.txt", "cat /p/tool-results/s.txt"]
    context = {r.timestamp: (r.user_text, r.assistant_text) for r in transcripts.context_calls(scan, f"{TOOL} search").collect()}
    assert context == {"t1": ("please search", "first\nsecond"), "t4": ("please search", "first\nsecond"), "t6": ("later question", "first\nsecond")}


def test_context_is_cut_to_its_end(spark, tmp_path):
    lines = [message("user", "t0", "x" * 2000 + "end"), message("assistant", "t1", [use("u1", f"{TOOL} search a b")])]
    write(tmp_path / "s.jsonl", "\n".join(lines))
    row = transcripts.context_calls(transcripts.read_lines(spark, str(tmp_path / "s.jsonl")), TOOL).first()
    assert len(row.user_text) == 1500 and row.user_text.endswith("end") and row.assistant_text == ""


def test_new_configurations(spark):
    snaps = spark.createDataFrame([("f1", "2", "a"), ("f2", "3", "b"), ("f2", "1", "c")], "fingerprint string, first_seen string, model string")
    known = spark.createDataFrame([("f1",)], "fingerprint string")
    assert [tuple(r) for r in logs.new_configurations(snaps, known).collect()] == [("f2", "1", "c")]
