"""N-gram Jaccard join by prefix trees.

1. Every text becomes the set of its distinct word n-grams, as 64-bit numbers; equal sets are one from here on (`signatures`).
2. A set that links must share most of its n-grams with another one, so it shares a known number of those with the smallest
   numbers. Counting who shares these (one shuffle of about a third of all n-grams) leaves the sets that can link at all
   (`_survivors`); for them the same is counted over whole sets.
3. The n-grams are ordered by how many sets hold them. Sets that share an n-gram among their rarest ones, as many as a link
   requires, are candidates; connected candidates are a cluster.
4. The sets of a cluster, in blocks, go into a trie with the commonest n-grams at its top. Each set walks down all branches at once:
   overlaps with a shared path are counted once, and a branch ends where what is left below it cannot reach the threshold.

All steps but the order of visits are exact: a pair that links shares an n-gram in step 3, hence meets in step 4. Pairs are
counted where they meet and only a spanning forest leaves the task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.functions.heavy import heavy_keys
from sondeo.llm.common import cut, needed, tidy
from sondeo.llm.components import Forest, components
from sondeo.llm.words import mix, windows, word_numbers

WIDTH = 5
#: A link: LINK[0] * common >= LINK[1] * (size + other size), which is 100 * common >= 75 * union.
LINK = (7, 3)
#: Share of a set's n-grams that step 2 looks at beyond the quarter a linked set may lack.
EXTRA = 0.1
#: Sets of a cluster that meet in one task; larger clusters are split into blocks which meet in pairs.
BLOCK = 2048


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct numbers of the n-grams; a text of fewer words counts as one n-gram, one without words has none."""
    words = word_numbers((text or "").encode("utf-8", "surrogatepass"), lower=True)
    if not len(words):
        return words
    found = np.sort(windows(words, min(width, len(words))))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def _identity(numbers: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(numbers.tobytes())
    return tuple(np.frombuffer(digest, "<i8").tolist())


def _sets(frames: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        rows = []
        for text in batch.column(1):
            numbers = shingles(text.as_py(), width)
            rows.append((len(numbers), *_identity(numbers)))
        n, low, high = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["id", "hash", "n", "low", "high"])


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """``id, hash, n, low, high``: a hash of every document's text, the size and the 128-bit identity of its n-gram set."""
    given = needed(docs, id=id_col, text=text_col).withColumn("hash", F.xxhash64("text"))
    kind = dict(given.dtypes)["id"]
    return given.mapInArrow(tidy(lambda frames: _sets(frames, width)), f"id {kind}, hash long, n long, low long, high long")


def looked_at(n):
    """How many of the smallest n-grams of a set of n step 2 looks at: a quarter, which a linked set may lack, and EXTRA of them."""
    return n // 4 + np.ceil(n * EXTRA).astype(np.int64)


def least_shared(n):
    """How many of these a set of n shares with some other set if it links: of the two sets, the one whose view ends first has at
    least three quarters as many n-grams, and all its looked-at ones but a quarter of its size are in the other's view."""
    return np.ceil(np.ceil(n * 0.75) * EXTRA)


def _small_tokens(frames: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        seen: set[int] = set()
        tokens, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        held = 0
        for text in batch.column(0):
            numbers = shingles(text.as_py(), width)
            low = _identity(numbers)[0]
            if not len(numbers) or low in seen:
                continue
            seen.add(low)
            few = numbers[:min(len(numbers), int(looked_at(np.int64(len(numbers)))))]
            tokens.append(few)
            owners.append(np.full(len(few), low, np.int64))
            held += len(few)
            if held > 200_000:
                yield _token_rows(tokens, owners)
                tokens, owners, held = [], [], 0
        if tokens:
            yield _token_rows(tokens, owners)


def _token_rows(tokens: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners))], ["token", "low"])


def _shared_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by token and set. For each set of a batch, how many of its tokens another set holds too. The last row of
    a batch waits for the next one, so that a token's rows may spread over any number of batches."""
    token, owner, before = np.empty(0, np.int64), np.empty(0, np.int64), False
    for batch in frames:
        token = np.concatenate([token, batch.column(0).to_numpy()])
        owner = np.concatenate([owner, batch.column(1).to_numpy()])
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]
        same = token[1:] == token[:-1]
        shared = np.concatenate([[before], same]) | np.concatenate([same, [False]])
        yield _counted(owner[:-1][shared[:-1]])
        before = bool(same[-1]) if len(same) else before
        token, owner = token[-1:], owner[-1:]
    if before:
        yield _counted(owner)


def _counted(owner: np.ndarray) -> pa.RecordBatch:
    low, n = np.unique(owner, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(n.astype(np.int64))], ["low", "n_shared"])


def _survivors(docs: DataFrame, sets: DataFrame, text_col: str, width: int) -> DataFrame:
    tokens = needed(docs, text=text_col).mapInArrow(tidy(lambda frames: _small_tokens(frames, width)), "token long, low long")
    counts = (tokens.repartition("token").sortWithinPartitions("token", "low").mapInArrow(tidy(_shared_counts), "low long, n_shared long")
              .groupBy("low").agg(F.sum("n_shared").alias("n_shared")))
    least = F.ceil(F.ceil(F.col("n") * 0.75) * EXTRA)
    return sets.join(counts, "low").where(F.col("n_shared") >= least).select("low", "n", "first", "mark", "copies")


def _numbers(frames: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in frames:
        lows, sets, held = [], [], 0
        for text, low in zip(batch.column(0), batch.column(1).to_pylist()):
            if low in seen:
                continue
            numbers = shingles(text.as_py(), width)
            if _identity(numbers)[0] != low:
                continue
            seen.add(low)
            lows.append(low)
            sets.append(numbers)
            held += len(numbers)
            if held > 200_000:
                yield _list_rows(lows, sets)
                lows, sets, held = [], [], 0
        if lows:
            yield _list_rows(lows, sets)


def _list_rows(lows: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), lists], ["low", "tokens"])


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows (token, low)`` with ``salts`` and ``salt``: tokens that fill more than a task's fair share are dealt to several salts by
    their sets, all others have one. The heavy tokens come from a sketch over all rows, so at most REPORTED of them are known."""
    heavy = rows.sparkSession.createDataFrame(heavy_keys(rows, ["token"]), "key long, salts long")
    known = rows.join(F.broadcast(heavy), F.xxhash64("token") == F.col("key"), "left")
    known = known.select("token", "low", F.coalesce("salts", F.lit(1)).alias("salts"))
    return known.withColumn("salt", F.pmod(F.xxhash64("low"), "salts"))


def ordered_sets(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, width: int = WIDTH) -> DataFrame:
    """``low, n, copies, tokens``: the sets that may link, with those n-grams that others of them hold, rarest first.

    A set's text is found by the id and the hash of one of its rows. Rows repeated as a whole give it several times, in several
    tasks too, so an n-gram counts once for each set. Heavy n-grams are counted nowhere as a whole: they come last in the order, and
    any order that is the same for all sets gives the same links."""
    few = cut(_survivors(docs, sets, text_col, width))
    texts = needed(docs, id=id_col, text=text_col).withColumn("hash", F.xxhash64("text"))
    texts = texts.join(few.select("first", "mark", "low"), F.col("id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("mark"))).select("text", "low")
    numbers = cut(texts.mapInArrow(tidy(lambda frames: _numbers(frames, width)), "low long, tokens array<long>"))
    rows = _dealt(numbers.select("low", F.explode("tokens").alias("token")))
    of_token = Window.partitionBy("token", "salt")
    once = rows.withColumn("before", F.lag("low").over(of_token.orderBy("low"))).where("NOT (low <=> before)")
    count = F.when(F.col("salts") > 1, F.col("salts") + (1 << 40)).otherwise(F.count("*").over(of_token))
    held = once.withColumn("df", count).where("df > 1").select("low", "df", "token")
    lists = held.groupBy("low").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).getField("token").alias("tokens"))
    return cut(few.join(lists, "low").where(F.size("tokens") >= F.ceil(F.col("n") * 0.75)).select("low", "n", "copies", "tokens"))


class Trie:
    """Paths of token lists, one node where lists part or end. ``edge`` holds all edge labels, a node's from ``start`` to ``end``."""

    def __init__(self, lists: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(lists)), key=lambda i: lists[i].tolist())
        self.parent, depth, start, end, labels, doc = [-1], [0], [0], [0], [], []
        at = 0
        path = [0]
        last = np.empty(0, np.int64)
        for i in order:
            own = lists[i]
            m = min(len(own), len(last))
            differ = np.flatnonzero(own[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            below = -1
            while depth[path[-1]] > common:
                below = path.pop()
            if below >= 0 and depth[path[-1]] < common:
                middle, over = len(depth), depth[path[-1]]
                self.parent.append(path[-1])
                depth.append(common)
                start.append(start[below])
                end.append(start[below] + common - over)
                self.parent[below], start[below] = middle, end[middle]
                path.append(middle)
            if len(own) > common:
                node = len(depth)
                self.parent.append(path[-1])
                depth.append(len(own))
                start.append(at)
                labels.append(own[common:])
                at += len(own) - common
                end.append(at)
                path.append(node)
            doc.append((path[-1], i))
            last = own
        self.edge = np.concatenate(labels) if labels else np.empty(0, np.int64)
        self.start, self.end, up, depth = (np.array(x) for x in (start, end, self.parent, depth))
        nodes = len(up)
        self.deepest, self.least = depth.copy(), np.full(nodes, np.iinfo(np.int64).max)
        at_node = np.array([n for n, _ in doc], np.int64)
        at_doc = np.array([i for _, i in doc], np.int64)
        np.minimum.at(self.least, at_node, sizes[at_doc])
        for node in np.argsort(-depth, kind="stable"):
            if up[node] >= 0:
                self.deepest[up[node]] = max(self.deepest[up[node]], self.deepest[node])
                self.least[up[node]] = min(self.least[up[node]], self.least[node])
        self.below = self.deepest - depth
        children = np.argsort(up, kind="stable")
        self.children, self.first = children, np.searchsorted(up[children], np.arange(nodes + 1))
        placed = np.argsort(at_node, kind="stable")
        self.docs, self.doc_first = at_doc[placed], np.searchsorted(at_node[placed], np.arange(nodes + 1))
        self.sizes = sizes

    @staticmethod
    def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions from first to last of each span, and the span each belongs to."""
        length = last - first
        owner = np.repeat(np.arange(len(first)), length)
        return np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first, length), owner

    def partners(self, mask: np.ndarray, n_tokens: int, size: int) -> np.ndarray:
        """The lists that link with the set whose tokens ``mask`` marks."""
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            at, owner = self._spans(self.doc_first[nodes], self.doc_first[nodes + 1])
            here = self.docs[at]
            found.append(here[LINK[0] * overlap[owner] >= LINK[1] * (size + self.sizes[here])])
            at, owner = self._spans(self.first[nodes], self.first[nodes + 1])
            nodes, overlap = self.children[at], overlap[owner]
            if not len(nodes):
                break
            at, owner = self._spans(self.start[nodes], self.end[nodes])
            overlap = overlap + np.bincount(owner, weights=mask[self.edge[at]], minlength=len(nodes)).astype(np.int64)
            best = overlap + np.minimum(self.below[nodes], n_tokens - overlap)
            open_ = LINK[0] * best >= LINK[1] * (size + self.least[nodes])
            nodes, overlap = nodes[open_], overlap[open_]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def join_block(table: pa.Table) -> pa.Table:
    """Sets of one block with one another, or those of the second block with a trie of the first. Returns each set's links found
    here, counted in documents, and the root of its tree in the forest of these links."""
    column = lambda name: table.column(name).to_numpy()
    i, j = column("i")[0], column("j")[0]
    tokens = table.column("tokens").combine_chunks()
    vocabulary, flat = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
    cuts = np.cumsum(tokens.value_lengths().to_numpy())[:-1]
    lists = [x[::-1] for x in np.split(flat.astype(np.int64), cuts)]
    low, size, copies = (column(c) for c in ("low", "n", "copies"))
    stored = np.flatnonzero(column("block") == i)
    probing = np.flatnonzero(column("block") == j) if i != j else stored
    trie = Trie([lists[k] for k in stored], size[stored])
    links, forest, mask = np.zeros(len(low), np.int64), Forest(), np.zeros(len(vocabulary), bool)
    for k in probing.tolist():
        mask[lists[k]] = True
        others = stored[trie.partners(mask, len(lists[k]), int(size[k]))]
        mask[lists[k]] = False
        others = others[others != k]
        links[k] += copies[others].sum()
        if i != j:
            links[others] += copies[k]
        for other in low[others].tolist():
            forest.join(int(low[k]), other)
    return pa.table({"low": low, "links": links, "root": np.array([forest.root(x) for x in low.tolist()], np.int64), "blocks": table.column("blocks")})


def _edges(prefix: DataFrame) -> DataFrame:
    """``a, b``: every set of a token is tied to the smallest set of the token's salt, and these to the smallest of all."""
    dealt = _dealt(prefix)
    least = F.min("low").over(Window.partitionBy("token", "salt"))
    tops = dealt.where("salts > 1").groupBy("token", "salt").agg(F.min("low").alias("a"))
    tops = tops.select("a", F.min("a").over(Window.partitionBy("token")).alias("b"))
    return dealt.select(F.col("low").alias("a"), least.alias("b")).union(tops)


def linked_sets(held: DataFrame, block: int = BLOCK) -> DataFrame:
    """``low, links, component`` of the sets in ``held`` that link with another; component is one of its sets."""
    own = F.col("n") - F.size("tokens")
    lead = F.floor(F.col("n") / 4).cast("long") + 1 - own
    prefix = held.where(lead > 0).select("low", F.explode(F.slice("tokens", F.lit(1), lead.cast("int"))).alias("token"))
    clusters = components(_edges(prefix)).select(F.col("node").alias("low"), F.col("component").alias("cluster"))
    members = held.join(clusters, "low")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("low"), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cluster", "low", "n", "copies", "tokens", "blocks", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = cut(met.groupBy("cluster", "i", "j").applyInArrow(join_block, "low long, links long, root long, blocks int"))
    split = components(rows.where("blocks > 1").select(F.col("low").alias("a"), F.col("root").alias("b")))
    whole = rows.where("blocks = 1").select(F.col("low").alias("node"), F.col("root").alias("component"))
    links = rows.groupBy("low").agg(F.sum("links").alias("links")).where("links > 0")
    return links.join(whole.union(split).select(F.col("node").alias("low"), "component"), "low")


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' signatures; their sets, each with its smallest id and the text hash of one row of that id; and the linked ones."""
    signed = cut(signatures(docs, id_col, text_col, width))
    mark = F.coalesce(F.min_by("hash", "id"), F.min("hash")).alias("mark")
    sets = cut(signed.where("n > 0").groupBy("low", "high", "n").agg(F.min("id").alias("first"), mark, F.count("*").alias("copies")))
    return signed, sets, linked_sets(ordered_sets(docs, id_col, text_col, sets, width), block)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """``id_col, n_shingles, component_id, n_links``, one row per row of ``docs``.

    n_links counts the other documents linked directly, equal sets among them. A text without words (or null) has no n-grams, no
    links and its own id as component. Repeated rows link with each other. An empty table gives an empty result. A row without id is
    scored, but it is never a component's name. Columns other than the two named are not read."""
    signed, sets, found = _linked(docs, id_col, text_col, width, block)
    named = found.join(sets.select("low", "first"), "low")
    names = named.groupBy("component").agg(F.min("first").alias("name"))
    named = named.join(names, "component").select("low", "links", "name")
    known = sets.join(named, "low", "left").select("low", "high", F.coalesce("name", "first").alias("name"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = signed.join(known, ["low", "high"], "left")
    own = F.col("n") == 0
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(own, F.col("id")).otherwise(F.col("name")).alias("component_id"),
                      F.when(own, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """One row of each component of linked rows, with all its columns: of its smallest id, or without id if all its rows are.

    Components are told apart by their n-gram sets, not by ids, so texts that do not link stay although they share an id or have
    none. Of rows repeated as a whole one stays; where rows of one id and text differ in other columns, a hash of all columns
    decides. Texts without words (or null) link with nothing and all stay. An empty table gives an empty result."""
    signed, sets, found = _linked(docs, id_col, text_col, width, block)
    of_all = sets.join(found.select("low", "component"), "low", "left")
    least = F.min(F.struct(F.col("first").isNull(), "first", "mark", "copies")).alias("c")
    chosen = of_all.where("component IS NOT NULL").groupBy("component").agg(least).select("c.first", "c.mark", "c.copies")
    chosen = chosen.union(of_all.where("component IS NULL").select("first", "mark", "copies"))
    chosen = cut(chosen.union(signed.where("n = 0").select("id", "hash", F.lit(1).cast("long")).distinct()))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("hash"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("mark")))
    again = kept.where("copies > 1").groupBy("first", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return kept.where("copies = 1").select("row.*").union(again.select("row.*"))
