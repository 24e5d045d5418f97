"""Token counts by dynamic programming in a trie of pre-tokens.

Distinct pre-tokens go into a trie. A node is a prefix; it holds the best score of all ways to spell it and how many tokens the best
has, computed once when the node is made, from the nodes above it. So words that begin alike share that work, and a pre-token's
count is its last node's. A document's count is the sum over its pre-tokens. A task's trie is emptied when it has too many nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sondeo.llm.common import needed
from sondeo.llm.unigram import BYTE_COST, NONE, PRE_TOKEN, Vocabulary, vocabulary

#: Nodes of a task's trie, and the longest pre-token that is stored; a longer one is solved by itself, in memory of its own length.
NODES, LONGEST = 400_000, 256


class CountTrie:
    def __init__(self, vocab: Vocabulary, nodes: int = NODES):
        self.vocab, self.most = vocab, nodes
        self.clear()

    def clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0], [0]
        self.known: dict[str, int] = {}

    def _step(self, path: list[int], token: str, depth: int) -> int:
        """The new node of ``token[:depth]`` below the nodes of its shorter prefixes."""
        behind, best, top, count = self.vocab.behind.get, self.best, NONE, 0
        for start in range(depth - 1, max(depth - self.vocab.longest, 0) - 1, -1):
            worth = behind(token[start:depth])
            if worth is None:
                break
            worth += best[path[start]]
            if worth >= top:
                top, count = worth, self.tokens[path[start]] + 1
        if token[depth - 1] not in self.vocab.score:
            size = len(token[depth - 1].encode("utf-8", "surrogatepass"))
            worth = self.best[path[depth - 1]] - BYTE_COST * size
            if worth > top:
                top, count = worth, self.tokens[path[depth - 1]] + size
        self.best.append(top)
        self.tokens.append(count)
        return len(self.best) - 1

    def count(self, token: str) -> int:
        found = self.known.get(token)
        if found is not None:
            return found
        if len(token) > LONGEST:
            return len(self.vocab.solve(token)[1])
        if len(self.best) > self.most:
            self.clear()
        path, step = [0], self.next
        for depth, char in enumerate(token, 1):
            node = step.get((path[-1], char))
            if node is None:
                node = step[path[-1], char] = self._step(path, token, depth)
            path.append(node)
        found = self.known[token] = self.tokens[path[-1]]
        return found


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """``id_col, n_pretokens, n_tokens`` of every row's whole text.

    Null and empty texts have none; repeated rows count alike; an empty table gives an empty result. Columns other than the two named are not read."""
    given = needed(docs, id=id_col, text=text_col)

    def counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountTrie(vocabulary(model), nodes)
        for batch in frames:
            parts, totals = [], []
            for value in batch.column(1):
                text = value.as_py()
                tokens = PRE_TOKEN.findall(" " + text) if text else []
                parts.append(len(tokens))
                try:
                    totals.append(sum(map(trie.known.__getitem__, tokens)))
                except KeyError:
                    totals.append(sum(map(trie.count, tokens)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.int64()), pa.array(totals, pa.int64())], ["id", "n_pretokens", "n_tokens"])

    return given.mapInArrow(counted, f"id {dict(given.dtypes)['id']}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
