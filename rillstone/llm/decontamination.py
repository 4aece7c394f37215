"""Benchmark decontamination by Wu-Manber search over words.

Every run of ``window`` consecutive words of a benchmark item, or a whole item
of fewer words, is a pattern. Patterns of one length share a searcher: its
shift table says, by the hash of the two words that end at a place, how far the
next possible end of a pattern is; where it says 0, a bucket of the patterns
with those last words is compared word by word, on their bytes. Documents
stream through; nothing is shuffled. Patterns go to the executors in blocks of
at most ``BLOCK_WORDS`` words, one pass over the documents for each block: where
there are more blocks than one, each pass's result is written before the next.

Edge cases: null texts have no words and hit nothing; null or empty items have
no windows; an item with a null id counts under the empty id, and repeated
items as one. Repeated documents get a result each, and so do those of a null
id. With no items nothing is contaminated, and an empty table gives an empty
result. A very long text is a piece of its own, which takes some 30 times its
bytes of a task's memory for a moment. Columns other than the id and text are
carried by `clean`, whatever their names, and ignored by `assess`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.columns import sheltered
from rillstone.llm.words import PLAIN, Words, buffers, pieces, scan
from rillstone.runtime import cut

WINDOW = 10
#: Words of benchmark items that one pass holds in memory.
BLOCK_WORDS = 1_000_000
_BITS = 16


class WuManber:
    """Finds patterns of one length: tuples of words, each a bytes object."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        words = [w for p in patterns for w in p]
        offsets = np.cumsum([0, *map(len, words)])
        scanned = Words(np.frombuffer(b"".join(words), np.uint8), offsets[:-1], offsets[1:], np.array([0, len(words)]))
        blocks = self.blocks(scanned.hashes()).reshape(len(patterns), length)
        self.shift = np.full(1 << _BITS, length - self.block + 1 if length - self.block + 1 < 255 else 255, np.uint8)
        for end in range(self.block - 1, length):
            at = self.place(blocks[:, end])
            self.shift[at] = np.minimum(self.shift[at], min(255, length - 1 - end))
        self.buckets: dict[int, list[tuple[bytes, set[str]]]] = defaultdict(list)
        for (pattern, items), last in zip(patterns.items(), blocks[:, -1].tolist(), strict=True):
            self.buckets[last].append((b" ".join(pattern), items))

    def blocks(self, h: np.ndarray) -> np.ndarray:
        """For each word the hash of the block that ends there."""
        if self.block == 1 or len(h) < 2:
            return h
        out = h.copy()
        out[1:] = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
        return out

    @staticmethod
    def place(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - _BITS)).astype(np.int64)

    def search(self, words: Words, h: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(text, place of the first word, items) of each occurrence."""
        blocks = self.blocks(h)
        shifts = self.shift[self.place(blocks)].tobytes()
        first = words.first.tolist()
        for doc, (low, high) in enumerate(zip(first, first[1:], strict=False)):
            at = low + self.length - 1
            while at < high:
                if step := shifts[at]:
                    at += step
                    continue
                for pattern, items in self.buckets.get(int(blocks[at]), ()):
                    begin = at - self.length + 1
                    if b" ".join(map(words.text, range(begin, at + 1))) == pattern:
                        yield doc, begin, items
                at += 1


def searchers(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """A searcher for each length of pattern."""
    found: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    buf, offsets = buffers(pa.array([t for _, t in items], pa.binary()))
    words = scan(buf, offsets, PLAIN, lower=True)
    first = words.first.tolist()
    for (item, _), low, high in zip(items, first, first[1:], strict=False):
        texts = [words.text(i) for i in range(low, high)]
        size = min(window, len(texts))
        for i in range(len(texts) - size + 1 if size else 0):
            found[size][tuple(texts[i : i + size])].add(item)
    return [WuManber(size, dict(patterns)) for size, patterns in sorted(found.items())]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    block, held, given = [], 0, False
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("binary").alias("t")).where("t is not null").toLocalIterator():
        block.append((row["i"], bytes(row["t"])))
        held += len(row["t"]) // 2 + 1
        if held >= block_words:
            yield block
            block, held, given = [], 0, True
    if block or not given:
        yield block


#: The searchers of the last block that this process was sent, by the block's name.
_LAST: dict[str, list[WuManber]] = {}


def _searchers_of(name: str, block: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    """Made once in a process, not once in a task."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = searchers(block, window)
    return _LAST[name]


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with __hits (a bit for each word, set where a pattern covers it), __items and __words."""
    out = docs.withColumns({"__hits": F.lit(None).cast("binary"), "__items": F.array().cast("array<string>"), "__words": F.lit(0).cast("long")})
    schema, before_it = out.schema, None
    for block in _blocks(benchmark, block_words):
        if before_it is not None:
            # the pass before ends here: its patterns leave the executors' memory
            out = cut(out)
            before_it.destroy()
        sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
        before_it = sent

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            finders = _searchers_of(name, sent.value, window)
            for part, buf, offsets in pieces(batches):
                words = scan(buf, offsets, PLAIN, lower=True)
                hit, items = np.zeros(len(words), bool), defaultdict(set)
                h = words.hashes() if finders else np.zeros(0, np.uint64)
                for finder in finders:
                    for doc, begin, found in finder.search(words, h):
                        hit[begin : begin + finder.length] = True
                        items[doc] |= found
                first = words.first.tolist()
                before, named = part.column("__hits").to_pylist(), part.column("__items").to_pylist()
                bits = []
                for doc, (low, high) in enumerate(zip(first, first[1:], strict=False)):
                    if doc not in items:
                        bits.append(before[doc])
                        continue
                    own = np.packbits(hit[low:high])
                    bits.append((own | np.frombuffer(before[doc], np.uint8) if before[doc] else own).tobytes())
                    named[doc] = sorted(items[doc].union(named[doc]))
                told = {"__hits": pa.array(bits, pa.binary()), "__items": pa.array(named, pa.list_(pa.string())), "__words": pa.array(words.counts, pa.int64())}
                yield pa.RecordBatch.from_arrays([told.get(n, part.column(n)) for n in part.schema.names], part.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def assess(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    found = search(docs.select("doc_id", "text"), benchmark, window)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) if b else 0 for b in batch.column("__hits").to_pylist()]
            items = batch.column("__items").to_pylist()
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests), pa.array([n > 0 for n in hits]), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    kind = dict(found.dtypes)["doc_id"]
    return found.drop("text").mapInArrow(count, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` that hold no benchmark window."""
    found = search(sheltered(docs), benchmark, window)
    return found.where("__hits is null").drop("__hits", "__items", "__words").toDF(*docs.columns)
