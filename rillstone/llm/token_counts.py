"""Greedy word-piece lengths by a linear longest-match automaton.

A word is a run of bytes other than white space, `[^\\x20\\x09-\\x0D]+`, with a
space before it: pieces that begin with a space can only open a word. Greedy
longest match takes, from the left, the longest piece of the vocabulary each
time. The automaton is the vocabulary's trie with, for each node, the number of
pieces that greedy matching takes off the node's text (its popped tokens) and a
failure link to the node of what remains. A word is read once, byte by byte,
and its length in pieces comes out without any piece being built.

A word that the vocabulary cannot spell counts as one unknown token.

Edge cases: null and empty texts have no words and no tokens. Repeated rows and
null ids get a result each. There are no ties: the longest piece is one. An
empty table gives an empty result. A very long text is a piece of its own, some
30 times its bytes in a task's memory for a moment. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.words import pieces, scan

#: Words whose lengths a worker remembers; beyond, it starts anew.
REMEMBERED = 300_000
_built: dict[str, Automaton] = {}


class Automaton:
    """Trie with failure links; nodes are numbers, 0 the root, -1 no node."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.step: dict[int, int] = {}
        whole, depth = [False], [(-1, 0)]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(whole)
                    whole.append(False)
                    depth.append((node, byte))
                node = self.step[key]
            whole[node] = whole[node] or bool(piece)
        self.fail, self.popped = [-1] * len(whole), [0] * len(whole)
        # parents come before children by level: visit nodes breadth first
        children: list[list[int]] = [[] for _ in whole]
        for node in range(1, len(whole)):
            children[depth[node][0]].append(node)
        queue = list(children[0])
        for node in queue:
            queue += children[node]
            if whole[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            parent, byte = depth[node]
            at, count = self.fail[parent], self.popped[parent]
            while at >= 0 and (at << 8 | byte) not in self.step:
                count += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.step[at << 8 | byte], count

    def count(self, word: bytes) -> int:
        """Pieces that greedy longest match makes of the word; 1 where it has none."""
        step, fail, popped = self.step, self.fail, self.popped
        node = count = 0
        for byte in word:
            while (following := step.get(node << 8 | byte)) is None:
                count += popped[node]
                if (node := fail[node]) < 0:
                    return 1
            node = following
        while node:
            count += popped[node]
            if (node := fail[node]) < 0:
                return 1
        return count


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def automaton(path: str) -> Automaton:
    """One automaton for each process."""
    if path not in _built:
        _built[path] = Automaton(read_ranks(path))
    return _built[path]


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def count_tokens(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_tokens."""
    path = vocabulary_path or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = automaton(path), {}
        for part, buf, offsets in pieces(batches):
            words = scan(buf, offsets)
            unlike, where, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            if len(known) > REMEMBERED:
                known.clear()
            lengths = []
            for h, i in zip(unlike.tolist(), where.tolist(), strict=True):
                if (n := known.get(h)) is None:
                    n = known[h] = matcher.count(b" " + words.text(i))
                lengths.append(n)
            sums = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64)[which])]) if len(words) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts, pa.int64()), pa.array(sums[words.first[1:]] - sums[words.first[:-1]], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
