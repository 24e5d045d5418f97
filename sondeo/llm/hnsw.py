"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one from here on. The vectors of a label are dealt into shards of bounded size; each gets a graph, built once. Every
shard of a label is asked by every other one (and by itself), one task for each two of them, which ask each other; what either finds
is a link, counted for both sides.
A search walks down the layers, keeps a beam on the lowest one, and then follows links from hit to hit until it meets no new one. Hits are
verified in double precision. Each task then audits itself: a bounded sample of vectors, half of them with links, is compared with the whole
shard, and copies of shard vectors that were moved half-way to the threshold are asked for. While a link of the sample was missed, or
more than a twentieth of the moved copies were not found, the beam is widened and all are asked again, at the end with a beam as wide as the
shard. What was found is one bit a pair; links are counted and components tied a batch of rows at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.common import cut, needed
from sondeo.llm.components import components

COSINE = 0.93
#: Vectors of a shard, links of a node (twice as many on the lowest layer), beams while building and asking, vectors audited per task.
SHARD, LINKS, BUILD_BEAM, BEAM, AUDIT = 8192, 16, 48, 48, 64
#: Moved copies that an audit asks for, and the share of them it must find.
MOVED, RECALL = 32, 0.95
#: Vectors that walk together, and nodes that each expands at a time.
TOGETHER, AT_A_TIME = 256, 4
SLACK = 1e-5
#: How much wider a beam gets when an audit fails.
WIDER = 4
#: Places of a node's list on the lowest layer that are kept for nodes without any other way in.
SPARE = 4


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Graph:
    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 1):
        self.exact = vectors
        self.x = vectors.astype(np.float32)
        n = len(vectors)
        level = np.minimum(-np.log(1 - np.random.RandomState(seed).random_sample(n)) / np.log(links), 12).astype(np.int64) if n else np.zeros(0, np.int64)
        self.layers = [np.full((n, 2 * links if k == 0 else links), -1, np.int64) for k in range(int(level.max(initial=0)) + 1)]
        self.entry, self.top = 0, int(level[0]) if n else 0
        done = 1
        while done < n:
            batch = np.arange(done, min(n, done + min(done, 2 * TOGETHER)))
            self._insert(batch, level, links, beam)
            done += len(batch)
        if n:
            self._connect()

    def _connect(self) -> None:
        """A way to every node of the lowest layer. Full lists drop links, so some nodes end up with none that leads to them: each such
        node gets one from its nearest node that can be reached and has a place left, in a few places kept for this."""
        table = self.layers[0] = np.pad(self.layers[0], ((0, 0), (0, SPARE)), constant_values=-1)
        reached = np.zeros(len(table), bool)

        def flood(front: np.ndarray) -> None:
            while len(front):
                reached[front] = True
                front = np.unique(table[front])
                front = front[(front >= 0) & ~reached[front]]

        flood(np.array([self.entry]))
        for node in np.flatnonzero(~reached):
            if not reached[node]:
                open_ = np.flatnonzero(reached & (table.min(axis=1) < 0))
                via = open_[np.argmax(self.x[open_] @ self.x[node])]
                table[via, np.argmin(table[via])] = node
                flood(np.array([node]))

    def _insert(self, batch: np.ndarray, level: np.ndarray, links: int, beam: int) -> None:
        at = np.full((len(batch), 1), self.entry)
        among = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(among, -np.inf)
        for k in range(len(self.layers) - 1, -1, -1):
            here = level[batch] >= k
            if k <= self.top:
                near, worth = self._beam(k, self.x[batch], at, beam if here.any() else 1)
                at = near[:, :1] if not here.all() else near
                at = np.where(at < 0, self.entry, at)
            else:
                near, worth = np.full((len(batch), 1), -1), np.full((len(batch), 1), -np.inf)
            if here.any():
                own, peers = np.flatnonzero(here), batch[here]
                peer_worth = among[np.ix_(own, own)]
                ids = np.concatenate([near[own], np.broadcast_to(peers, (len(own), len(own)))], axis=1)
                chosen = self._choose(batch[own], ids, np.concatenate([worth[own], peer_worth], axis=1), links)
                self.layers[k][batch[own], :links] = chosen
                self._back_links(k, batch[own], chosen)
        highest = batch[np.argmax(level[batch])]
        if level[highest] > self.top:
            self.entry, self.top = int(highest), int(level[highest])

    def _choose(self, nodes: np.ndarray, ids: np.ndarray, worth: np.ndarray, keep: int) -> np.ndarray:
        """For each node up to ``keep`` of its candidates: those nearer to it than to one already chosen, then the nearest of the rest."""
        width = min(ids.shape[1], 3 * keep)
        worth = np.where(ids < 0, -np.inf, worth)
        order = np.argsort(-worth, axis=1, kind="stable")[:, :width]
        ids, worth = np.take_along_axis(ids, order, 1), np.take_along_axis(worth, order, 1)
        v = self.x[np.maximum(ids, 0)]
        mutual = v @ v.transpose(0, 2, 1)
        usable = np.isfinite(worth)
        picked, count = np.zeros(ids.shape, bool), np.zeros(len(ids), np.int64)
        nearest = np.full(ids.shape, -np.inf, np.float32)
        for c in range(width):
            take = usable[:, c] & (worth[:, c] > nearest[:, c]) & (count < keep)
            picked[:, c] = take
            count += take
            nearest = np.where(take[:, None], np.maximum(nearest, mutual[:, c, :]), nearest)
        rank = np.where(picked, 0, np.where(usable, 1, 2)) * width + np.arange(width)
        best = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        out = np.where(np.take_along_axis(usable, best, 1), np.take_along_axis(ids, best, 1), -1)
        return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)

    def _back_links(self, k: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        table = self.layers[k]
        room = table.shape[1]
        target, source = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        known = (table[target] == source[:, None]).any(axis=1)
        target, source = target[~known], source[~known]
        if not len(target):
            return
        ends, first, count = np.unique(target, return_index=True, return_counts=True)
        for few in np.array_split(np.arange(len(ends)), -(-len(ends) // 512)):
            width = int(count[few].max())
            new = np.full((len(few), width), -1)
            place = np.arange(width)
            inside = place < count[few][:, None]
            new[inside] = source[(first[few][:, None] + place)[inside]]
            ids = np.concatenate([table[ends[few]], new], axis=1)
            worth = np.einsum("nd,nkd->nk", self.x[ends[few]], self.x[np.maximum(ids, 0)])
            table[ends[few]] = self._choose(ends[few], ids, worth, room)

    def _beam(self, k: int, q: np.ndarray, at: np.ndarray, width: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes of layer k that each query's walk finds from ``at``, nearest first."""
        if len(q) > TOGETHER and seen is None:
            parts = [self._beam(k, q[i:i + TOGETHER], at[i:i + TOGETHER], width) for i in range(0, len(q), TOGETHER)]
            wide = max(p[0].shape[1] for p in parts)
            pad = lambda a, v: np.pad(a, ((0, 0), (0, wide - a.shape[1])), constant_values=v)
            return np.concatenate([pad(p[0], -1) for p in parts]), np.concatenate([pad(p[1], -np.inf) for p in parts])
        table, rows = self.layers[k], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x)), bool) if seen is None else seen
        marks = np.zeros(seen.shape, np.int32)
        ids, worth, open_ = np.full((len(q), 0), -1), np.full((len(q), 0), -np.inf, np.float32), np.zeros((len(q), 0), bool)
        new = at
        while True:
            place = np.broadcast_to(np.arange(1, new.shape[1] + 1, dtype=np.int32), new.shape)
            ok = (new >= 0) & ~seen[rows, new]
            marks[rows, new] = place
            ok &= marks[rows, new] == place
            r, c = np.nonzero(ok)
            seen[r, new[r, c]] = True
            value = np.full(new.shape, -np.inf, np.float32)
            value[r, c] = np.einsum("nd,nd->n", q[r], self.x[new[r, c]])
            ids, worth, open_ = np.concatenate([ids, np.where(ok, new, -1)], 1), np.concatenate([worth, value], 1), np.concatenate([open_, ok], 1)
            best = np.argsort(-worth, axis=1, kind="stable")[:, :width]
            ids, worth, open_ = (np.take_along_axis(a, best, 1) for a in (ids, worth, open_))
            if not open_.any():
                return ids, worth
            turn = np.cumsum(open_, axis=1)
            go = open_ & (turn <= AT_A_TIME)
            first = np.argsort(~go, axis=1, kind="stable")[:, :AT_A_TIME]
            from_ = np.where(np.take_along_axis(go, first, 1), np.take_along_axis(ids, first, 1), -1)
            open_ &= ~go
            new = np.where(from_[:, :, None] >= 0, table[np.maximum(from_, 0)], -1).reshape(len(q), -1)

    def mark(self, found: np.ndarray, q: np.ndarray, cosine: float, width: int, own: np.ndarray | None = None) -> None:
        """Sets the bits (query, node) of all pairs at ``cosine`` or more that a beam of ``width`` leads to. Where the beam holds nothing but
        hits there may be any number more: such a query is compared with the shard. Queries that are nodes, ``own``, also start from themselves."""
        for i in range(0, len(q), TOGETHER):
            part = q[i:i + TOGETHER].astype(np.float32)
            at = np.full((len(part), 1), self.entry)
            for k in range(self.top, 0, -1):
                at = self._beam(k, part, at, 1)[0]
            if own is not None:
                at = np.concatenate([at, own[i:i + TOGETHER, None]], axis=1)
            seen = np.zeros((len(part), len(self.x)), bool)
            ids, worth = self._beam(0, part, at, width, seen)
            wide = np.flatnonzero((worth >= cosine - SLACK).all(axis=1))
            found[i + wide] = q[i + wide] @ self.exact.T >= cosine
            worth[wide] = -np.inf
            r, c = np.nonzero(worth >= cosine - SLACK)
            who, node = r, ids[r, c]
            while len(who):
                for j in range(0, len(who), 100_000):
                    a, b = who[j:j + 100_000], node[j:j + 100_000]
                    sure = np.einsum("nd,nd->n", q[i + a], self.exact[b]) >= cosine
                    found[i + a[sure], b[sure]] = True
                near = self.layers[0][node]
                flat = np.unique((np.repeat(who, near.shape[1]) * len(self.x) + near.ravel())[near.ravel() >= 0])
                who, node = flat // len(self.x), flat % len(self.x)
                fresh = ~seen[who, node]
                who, node = who[fresh], node[fresh]
                seen[who, node] = True
                hit = np.einsum("nd,nd->n", part[who], self.x[node]) >= cosine - SLACK
                who, node = who[hit], node[hit]

    def passes(self, found: np.ndarray, q: np.ndarray, cosine: float, width: int, audit: int) -> bool:
        """Whether no link of ``audit`` sampled queries is missing in ``found`` and moved copies of nodes are found by such a beam."""
        evenly = lambda of, n: of[np.unique(np.linspace(0, len(of) - 1, min(n, len(of))).astype(np.int64))] if len(of) else of
        linked = np.flatnonzero(found.sum(axis=1) > (q is self.exact))
        some = np.arange(len(q))
        if audit < len(q):
            some = np.unique(np.concatenate([evenly(linked, audit // 2), evenly(some, audit - audit // 2)]))
        for i in range(0, len(some), TOGETHER):
            rows = some[i:i + TOGETHER]
            if ((q[rows] @ self.exact.T >= cosine) & ~found[rows]).any():
                return False
        if self.exact.shape[1] < 2:
            return True
        places = evenly(np.arange(len(self.exact)), MOVED)
        moved = np.random.RandomState(5).standard_normal((len(places), self.exact.shape[1]))
        moved = unit(moved - np.einsum("nd,nd->n", moved, self.exact[places])[:, None] * self.exact[places] + 1e-12)
        near = (1 + cosine) / 2
        asked = np.zeros((len(places), len(self.exact)), bool)
        self.mark(asked, unit(near * self.exact[places] + np.sqrt(1 - near * near) * moved), cosine, width)
        return bool(asked[np.arange(len(places)), places].mean() >= RECALL)

    def asked(self, q: np.ndarray, cosine: float, width: int, audit: int) -> tuple[np.ndarray, int]:
        """A bit for each (query, node) that links, by the first of ever wider beams that passes its audit, and that beam's width. Where the
        shard asks itself, a link that either side finds counts for both. Should the widest beam fail as well, the graph has lost its
        ways, and all are compared."""
        own = np.arange(len(q)) if q is self.exact else None
        while True:
            found = np.zeros((len(q), len(self.x)), bool)
            self.mark(found, q, cosine, width, own)
            if own is not None:
                found |= found.T
            if self.passes(found, q, cosine, width, audit):
                return found, width
            if width >= len(self.x):
                for i in range(0, len(q), TOGETHER):
                    found[i:i + TOGETHER] = q[i:i + TOGETHER] @ self.exact.T >= cosine
                return found, width
            width = min(width * WIDER, len(self.x))

    def audited(self, q: np.ndarray, cosine: float, width: int, audit: int) -> tuple[np.ndarray, np.ndarray, int]:
        """What ``asked`` found as pairs."""
        found, width = self.asked(q, cosine, width, audit)
        return *np.nonzero(found), width


def between(one: Graph, other: Graph, cosine: float, width: int, audit: int) -> np.ndarray:
    """A bit for each (node of other, node of one) that links: each asks the other, and what either finds counts."""
    found, _ = one.asked(other.exact, cosine, width, audit)
    found |= other.asked(one.exact, cosine, width, audit)[0].T
    return found


def _index(frame: pd.DataFrame) -> pd.DataFrame:
    """One shard's vectors and its graph's layers, as bytes."""
    frame = frame.sort_values("order")
    vectors = np.array(frame["vector"].tolist(), np.float64)
    graph = Graph(unit(vectors))
    first = frame.iloc[0]
    return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "shard": [first["shard"]], "shards": [first["shards"]], "ids": [frame["first"].to_numpy(np.int64).tobytes()],
                         "copies": [frame["copies"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()], "entry": [graph.entry], "top": [graph.top],
                         "layers": [[layer.astype(np.int32).tobytes() for layer in graph.layers]]})


def _loaded(row: pd.Series) -> tuple[Graph, np.ndarray, np.ndarray]:
    ids, copies = (np.frombuffer(row[c], np.int64) for c in ("ids", "copies"))
    graph = Graph(np.empty((0, int(row["dim"]))))
    graph.exact = unit(np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1))
    graph.x, graph.entry, graph.top = graph.exact.astype(np.float32), int(row["entry"]), int(row["top"])
    graph.layers = [np.frombuffer(x, np.int32).astype(np.int64).reshape(len(ids), -1) for x in row["layers"]]
    return graph, ids, copies


def _tied(found: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column the smallest name among those that the set bits connect it with."""
    names = np.concatenate([rows, columns])
    order = np.unique(names)
    low = np.searchsorted(order, names)
    place = np.full(len(order), -1)
    place[low[::-1]] = np.arange(len(names))[::-1]
    while True:
        new = low.copy()
        for i in range(0, len(rows), TOGETHER):
            bits = found[i:i + TOGETHER]
            mine = np.arange(i, i + len(bits))
            new[mine] = np.minimum(new[mine], np.where(bits, low[len(rows):], len(order)).min(axis=1, initial=len(order)))
            new[len(rows):] = np.minimum(new[len(rows):], np.where(bits, low[mine][:, None], len(order)).min(axis=0, initial=len(order)))
        # Rows and columns of one name are one node.
        least = np.full(len(order), len(order))
        np.minimum.at(least, np.searchsorted(order, names), new)
        new = least[np.searchsorted(order, names)]
        new = np.minimum(new, new[place[new]])
        if (new == low).all():
            return order[low[:len(rows)]], order[low[len(rows):]]
        low = new


def _counted(found: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row and each column, every one as often as its other side has copies."""
    of_rows, of_columns = np.zeros(len(rows)), np.zeros(len(columns))
    for i in range(0, len(rows), TOGETHER):
        bits = found[i:i + TOGETHER].astype(np.float64)
        of_rows[i:i + TOGETHER] = bits @ columns
        of_columns += rows[i:i + TOGETHER] @ bits
    return of_rows, of_columns


def _ask(cosine: float, beam: int, audit: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Two shards, or one and itself: links of every vector, counted with copies, and the roots of the forest they span."""
        frame = frame.sort_values("shard")
        graph, ids, copies = _loaded(frame.iloc[0])
        if len(frame) == 1:
            found, _ = graph.asked(graph.exact, cosine, beam, audit)
            np.fill_diagonal(found, False)
            names, links, roots = ids, _counted(found, copies, copies)[0], _tied(found, ids, ids)[0]
        else:
            other, other_ids, other_copies = _loaded(frame.iloc[1])
            found = between(graph, other, cosine, beam, audit)
            names = np.concatenate([other_ids, ids])
            links, roots = np.concatenate(_counted(found, other_copies, copies)), np.concatenate(_tied(found, other_ids, ids))
        out = pd.DataFrame({"id": names, "links": links.astype(np.int64), "root": roots, "shards": int(frame["shards"].iloc[0])})
        return out[out["links"] > 0]
    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
                    shard: int = SHARD, beam: int = BEAM, audit: int = AUDIT) -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row per row of ``rows``.

    Vectors of one label and one length are compared. A null label, and a vector that is null, empty, all zero, or holds a null or a
    number that is not finite, links with nothing: it is its own component and kept. Equal vectors (repeated rows too) link with each
    other. Ids are whole numbers. An empty table gives an empty result. Columns other than the three named are not read."""
    given = needed(rows, id=id_col, vector=vector_col, label=label_col).withColumn("id", F.col("id").cast("long")).withColumn("vector", F.col("vector").cast("array<double>"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.coalesce(F.col("label").isNotNull() & (F.size("vector") > 0) & ~odd & F.exists("vector", lambda v: v != 0), F.lit(False))
    given = cut(given.withColumn("fit", fit).withColumn("label", F.col("label").cast("string")).withColumn("hash", F.xxhash64("vector")))
    key = ["label", "hash", "vector"]
    distinct = cut(given.where("fit").groupBy(key).agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    sized = distinct.withColumn("dim", F.size("vector"))
    shards = sized.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = sized.join(shards, ["label", "dim"]).withColumn("order", F.xxhash64("first", F.lit(3))).withColumn("shard", F.pmod(F.xxhash64("first"), "shards").cast("int"))
    index = cut(dealt.groupBy("label", "dim", "shard").applyInPandas(
        _index, "label string, dim int, shard int, shards int, ids binary, copies binary, vectors binary, entry long, top int, layers array<binary>"))
    met = index.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = met.withColumn("i", F.least("shard", "other")).withColumn("j", F.greatest("shard", "other")).drop("other")
    found = cut(met.groupBy("label", "dim", "i", "j").applyInPandas(_ask(cosine, beam, audit), "id long, links long, root long, shards int"))
    split = components(found.where("shards > 1").select(F.col("id").alias("a"), F.col("root").alias("b")))
    whole = found.where("shards = 1").select(F.col("id").alias("node"), F.col("root").alias("component")).union(split)
    links = found.groupBy("id").agg(F.sum("links").alias("links")).join(whole.withColumnRenamed("node", "id"), "id", "left").withColumnRenamed("id", "first")
    known = distinct.join(links, "first", "left").select(*key, F.coalesce("component", "first").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = given.where("fit").join(known, key).select("id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    out = out.union(given.where("NOT fit").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
