"""Jobs over arriving files."""

from datetime import datetime, timedelta

from sondeo.operators import loganalytics as la
from sondeo.streaming import jobs


def test_streamed_attribution_forms_no_pairs(spark, tmp_path):
    """Two arrivals over three hours: every expand gets what the batch join gives it, by two candidates a batch at most."""
    base = datetime(2024, 1, 1)
    lists = [(f"s{i:03d}", base + timedelta(minutes=i), "c", f"d{i % 2}", i % 3, 1 + i % 2) for i in range(150)]
    lists += [("s000x", base + timedelta(minutes=30), "c", "d0", 0, 1), ("s999", base, None, "d0", 0, 1)]
    lists += [("s998", None, "c", "d0", 0, 1), (None, base, "c", "d0", 0, 1)]
    expands = [("e998", None, "c", "d0", 0), ("e999", base, "c", None, None)] + [(f"e{i:03d}", base + timedelta(minutes=7 * i, seconds=20), "c", f"d{i % 3}", i % 4) for i in range(32)]
    kinds = {"lists": (lists, "search_id string, ts timestamp, collection string, document string, chunk_index int, hit_rank int"),
             "expands": (expands, "expand_id string, ts timestamp, collection string, document string, chunk_index int")}
    streams = {}
    for name, (rows, schema) in kinds.items():
        half = len(rows) // 2
        for part in (rows[:half], rows[half:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams[name] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = jobs.append_to(jobs.attribution_candidates(streams["expands"], streams["lists"], "1 day"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() <= 3 * len(expands)
    got = {(r.expand_id, r.search_id, r.kind, r.hit_rank) for r in jobs.best_candidates(found).collect()}
    lists = [r for r in lists if r[0] and r[1]]
    log = spark.createDataFrame([r[:3] for r in lists], "search_id string, ts timestamp, collection string")
    hits = spark.createDataFrame([(r[0], r[3], r[4], r[5]) for r in lists], "search_id string, document string, chunk_index int, rank int")
    batch = la.attribute_expands(spark.createDataFrame(*kinds["expands"]), log, hits)
    want = {(r.expand_id, r.search_id, r.kind, r.hit_rank) for r in batch.collect()}
    assert {r for r in got if r[1]} == {r for r in want if r[1]} and len(want) == 34
