"""Search modes as compositions of ranked lists, and the grid of a sweep as one job."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sondeo.operators import filters, fusion, retrieval
from sondeo.session import checkpointed

Q = ["query_id"]


def base_mode(mode: str) -> str:
    return mode.split("+")[0]


def made_once(lists: dict[str, DataFrame], modes: Iterable[str]) -> dict[str, DataFrame]:
    """The lists that the modes read, searched for once: several modes read the same, and a fusion reads them more than once."""
    needed = {x for mode in modes for x in (("dense", "sparse") if base_mode(mode) in ("hybrid", "cc") else (base_mode(mode),))}
    return {name: checkpointed(hits) if name in needed else hits for name, hits in lists.items()}


def retrieve(
    mode: str, lists: dict[str, DataFrame], top_k: int, alpha: float = retrieval.ALPHA, rrf_k: int = retrieval.RRF_K,
    rerank_candidates: int = retrieval.CANDIDATES, threshold: float = 0.0,
    score_pairs: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Hits of one mode. ``lists`` holds the fetched candidates: dense and sparse 50 deep, bm25 to its own depth.

    A reranked mode sends ``rerank_candidates`` to ``score_pairs``, which adds their ``relevance``; lists must be fetched as deep.
    """
    reranked = "+rerank" in mode
    depth = rerank_candidates if reranked else top_k
    base = base_mode(mode)
    if base == "hybrid":
        hits = fusion.reciprocal_rank(lists["dense"], lists["sparse"], rrf_k, k=depth)
    elif base == "cc":
        hits = fusion.convex(lists["dense"], lists["sparse"], alpha, k=depth)
    else:
        hits = lists[base].filter(F.col("rank") <= depth)
    if reranked:
        hits = retrieval.apply_rerank(score_pairs(hits), top_k)
    hits = filters.above_threshold(hits, mode, threshold)
    return hits.select("query_id", "rank", *retrieval.KEY, "score")


def mode_table(modes: list[str], lists: dict[str, DataFrame], top_k: int, **params) -> DataFrame:
    """Hits of every mode side by side with a ``mode`` column."""
    lists = made_once(lists, modes)
    out = None
    for mode in modes:
        part = retrieve(mode, lists, top_k, **params).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def grid(ranges: dict[str, list], base: dict) -> list[dict]:
    """Parameter cells: the product of the swept ranges over a base configuration, numbered in sweep order."""
    rows = [dict(base)]
    for name, values in ranges.items():
        rows = [{**r, name: v} for r in rows for v in values]
    return [{"cell": i, **r} for i, r in enumerate(rows)]


def with_cells(df: DataFrame, cells: list[dict], fields: list[str]) -> DataFrame:
    """Every row once per cell, with the named parameters. The grid is written by hand and becomes a literal array."""
    if not cells:
        cells, keep = [{f: None for f in fields}], False
    else:
        keep = True
    types = {int: "long", float: "double", str: "string", bool: "boolean"}
    literals = [F.struct(*[F.lit(c[f]).cast(types.get(type(c[f]), "string")).alias(f) for f in fields]) for c in cells]
    spread = df.withColumn("_cell", F.explode(F.array(*literals)))
    return (spread if keep else spread.filter(F.lit(False))).select(*df.columns, *[F.col(f"_cell.{f}").alias(f) for f in fields])


def numbered(df: DataFrame, cells: list[dict], fields: list[str]) -> DataFrame:
    """Rows with the number of their cell, which ``fields`` name, in the column cell. Rows of no cell drop out."""
    of = [F.when(reduce(lambda a, b: a & b, [F.col(f) == F.lit(c[f]) for f in fields]), F.lit(c["cell"])) for c in cells]
    return df.withColumn("cell", F.coalesce(*of).cast("long")).filter(F.col("cell").isNotNull())


def sweep(lists: dict[str, DataFrame], cells: list[dict], score_pairs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Hits (cell, query_id, rank, key, score) of all cells in one job: cells meet the short candidate lists, not the chunks.

    Cells name mode, top_k, alpha, rrf_k and score_threshold; those of reranked modes rerank_candidates too, which their lists
    must reach. All reranked cells are scored together by ``score_pairs``, which adds ``relevance`` to their candidates.
    """
    unknown = sorted({c["mode"] for c in cells if base_mode(c["mode"]) not in ("hybrid", "cc", "dense", "sparse", "bm25")})
    if unknown or not cells:
        raise ValueError(f"no cells, or modes that a sweep does not know: {unknown}")
    if score_pairs is None and any("+rerank" in c["mode"] for c in cells):
        raise ValueError("modes with rerank need a scorer")
    cells = [{**c, "depth": c.get("rerank_candidates", retrieval.CANDIDATES) if "+rerank" in c["mode"] else c["top_k"]} for c in cells]

    lists = made_once(lists, [c["mode"] for c in cells])

    def of(base: str) -> list[dict]:
        return [c for c in cells if base_mode(c["mode"]) == base]

    limits = ["top_k", "score_threshold", "mode", "depth"]
    parts = []
    for mode, fuse, parameter in (("hybrid", fusion.reciprocal_rank, "rrf_k"), ("cc", fusion.convex, "alpha")):
        if of(mode):
            # Lists are fused once for each value of the parameter; the cells that have it share what comes out.
            values = [{"_value": v} for v in dict.fromkeys(c[parameter] for c in of(mode))]
            dense, sparse = (with_cells(lists[x], values, ["_value"]) for x in ("dense", "sparse"))
            fused = fuse(dense, sparse, F.col("_value"), ["_value", *Q])
            parts.append(with_cells(fused, of(mode), ["cell", *limits, parameter]).filter(F.col(parameter) == F.col("_value")))
    for mode in ("dense", "sparse", "bm25"):
        if of(mode):
            parts.append(with_cells(lists[mode], of(mode), ["cell", *limits]))
    columns = ["cell", *limits, *Q, "rank", *retrieval.KEY, "score"]
    hits = reduce(DataFrame.unionByName, [part.select(*columns) for part in parts]).filter(F.col("rank") <= F.col("depth"))
    reranked = F.col("mode").contains("+rerank")
    if score_pairs is not None:
        deepest = max(c["top_k"] for c in cells)
        again = retrieval.apply_rerank(score_pairs(hits.filter(reranked)), deepest, ["cell", *limits, *Q])
        hits = hits.filter(~reranked).unionByName(again.select(*columns))
    exempt = F.col("mode").isin(*filters.THRESHOLD_EXEMPT)
    kept = (F.col("rank") <= F.col("top_k")) & (exempt | (F.col("score_threshold") <= 0) | (F.col("score") >= F.col("score_threshold")))
    return hits.filter(kept).drop(*limits)


def run_specs(specs: DataFrame, chunks: DataFrame, score_pairs: Callable[[DataFrame], DataFrame], candidates: int = retrieval.RERANK_CANDIDATES) -> DataFrame:
    """Ranked hits of every search spec (query_id, embedding, filters, depth and what else names it), full rerank depth.

    Unlike the production search no score is cut off; ``kept`` marks the hits within the depth of the spec.
    """
    ranked = retrieval.apply_rerank(score_pairs(retrieval.dense_top_k(specs, chunks, candidates)), candidates)
    rest = [c for c in specs.columns if c not in ("embedding", *retrieval.FILTERS)]
    return ranked.join(specs.select(*rest), "query_id").withColumn("kept", F.col("rank") <= F.col("depth"))


def stored_contents(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Content of every chunk that some run kept."""
    keys = runs.filter("kept").select(*retrieval.KEY).distinct()
    return chunks.join(keys, retrieval.KEY, "left_semi").select(*retrieval.KEY, "content")
