"""Quality classifier: a byte-level convolutional network in numpy.

Filters run over every place of a document's bytes. The document is covered by
chunks of two blocks of ``BLOCK`` bytes, each overlapping the next by one; a
chunk's features are its filters' largest values. The mean and the maximum of
the chunks' features go through one logistic unit.

The network is trained on at most ``TRAIN_DOCUMENTS`` labelled documents, taken
by a hash of their id, whole texts of at most ``TRAIN_TEXT`` bytes and
``TRAIN_BYTES`` together, in one task; its weights are a few kilobytes. Scoring
streams over all documents, whole texts too: a long one is read block by block,
with the sum and the maximum so far and the last block's values carried on.

Edge cases: a null or empty text has one block of padding and the score that
comes of it. Labels of null id or value aren't learned from; of an id's several
labels the mean counts, and a tie is left out. Without labels of both kinds
every score is the share of label 1, or 0.5 without any. Repeated rows get a
score each. An empty table gives an empty result. A very long text takes a few
times its own bytes of a task's memory, for its copy from Arrow, and 60 MB of
work space. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.words import buffers

BLOCK = 256
WIDTH = 5
FILTERS = 16
PAD = 256
TRAIN_DOCUMENTS = 4000
EPOCHS = 6
BATCH = 32
RATE = 0.02
DECAY = 1e-4
#: Texts of more bytes aren't learned from, nor are more bytes in all: a bounded sample.
TRAIN_TEXT, TRAIN_BYTES = 1 << 20, 1 << 26
#: Bytes of a batch in training, but for its last text.
BATCH_BYTES = 1 << 19
#: Bytes that scoring holds at a time; a longer text is scored in parts.
PIECE = 1 << 17


def padded(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts in whole blocks, with padding before and after each, and the first block of each.

    Block k is at `k * BLOCK + WIDTH - 1`: a filter at a place looks back, at padding before a text's first byte.
    """
    lengths = np.diff(offsets)
    blocks = (lengths + WIDTH - 1 + BLOCK - 1) // BLOCK
    blocks = np.maximum(blocks, 1)
    first = np.append(0, np.cumsum(blocks))
    symbols = np.full(int(first[-1]) * BLOCK + WIDTH - 1, PAD, np.int64)
    symbols[np.arange(len(buf)) + np.repeat(first[:-1] * BLOCK + WIDTH - 1 - offsets[:-1], lengths)] = buf
    return symbols, first


class Network:
    """Filters as a table of (place in the filter, byte, filter), and the last unit."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
        self.table[:, PAD] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.weight = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def activations(self, symbols: np.ndarray) -> np.ndarray:
        """(block, place, filter) values."""
        n = len(symbols) - WIDTH + 1
        out = np.take(self.table[0], symbols[:n], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.table[j], symbols[j : n + j], axis=0)
        return out.reshape(-1, BLOCK, FILTERS)

    def features(self, largest: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document features from the blocks' largest values; the chunks' features; the first chunk of each document."""
        blocks = np.diff(first)
        # a chunk is a block and the next of the same document; a lone block is one
        chunks = np.maximum(blocks - 1, 1)
        begins = np.append(0, np.cumsum(chunks))
        at = np.repeat(first[:-1] - begins[:-1], chunks) + np.arange(begins[-1])
        after = np.minimum(at + 1, np.repeat(first[1:] - 1, chunks))
        held = np.maximum(np.maximum(largest[at], largest[after]) + self.bias, 0)
        mean = np.add.reduceat(held, begins[:-1], axis=0) / chunks[:, None]
        return np.concatenate([mean, np.maximum.reduceat(held, begins[:-1], axis=0)], axis=1), held, begins

    def logits(self, features: np.ndarray) -> np.ndarray:
        return (features * self.weight).sum(axis=1) + self.offset[0]

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of texts that are few bytes together, or of one long text."""
        if len(offsets) == 2 and len(buf) > PIECE:
            found = self.long_features(buf)[None]
        else:
            symbols, first = padded(buf, offsets)
            found, _, _ = self.features(self.activations(symbols).max(axis=1), first)
        return 1 / (1 + np.exp(-self.logits(found).astype(np.float64)))

    def long_features(self, text: np.ndarray) -> np.ndarray:
        """What `features` gives of one text, of any length, part by part."""
        blocks, step, back = max(1, -(-(len(text) + WIDTH - 1) // BLOCK)), max(1, PIECE // BLOCK), WIDTH - 1
        total, top, before = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), None
        for low in range(0, blocks, step):
            n = min(step, blocks - low)
            symbols = np.full(n * BLOCK + back, PAD, np.int64)
            begin = low * BLOCK - back
            part = text[max(0, begin) : begin + len(symbols)]
            symbols[max(0, -begin) : max(0, -begin) + len(part)] = part
            largest = self.activations(symbols).max(axis=1)
            if before is not None:
                largest = np.concatenate([before[None], largest])
            before = largest[-1]
            # a chunk is a block and the next; the part's last block waits for its next
            chunks = largest if blocks == 1 else np.maximum(largest[:-1], largest[1:])
            held = np.maximum(chunks + self.bias, 0)
            total += held.sum(axis=0, dtype=np.float64)
            top = np.maximum(top, held.max(axis=0, initial=0))
        return np.concatenate([(total / max(1, blocks - 1)).astype(np.float32), top])

    def gradients(self, buf: np.ndarray, offsets: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss by table, bias, weight and offset."""
        symbols, first = padded(buf, offsets)
        values = self.activations(symbols)
        place = values.argmax(axis=1)
        largest = np.take_along_axis(values, place[:, None, :], axis=1)[:, 0]
        found, held, begins = self.features(largest, first)
        error = ((1 / (1 + np.exp(-self.logits(found))) - target) / len(target)).astype(np.float32)
        chunks = np.diff(begins)
        doc = np.repeat(np.arange(len(target)), chunks)
        down = error[doc, None] * self.weight[:FILTERS] / chunks[doc, None]
        top = held == found[doc, FILTERS:]
        ties = np.maximum(np.add.reduceat(top, begins[:-1], axis=0), 1)
        down = (down + error[doc, None] * self.weight[FILTERS:] * top / ties[doc]) * (held > 0)
        at = np.repeat(first[:-1] - begins[:-1], chunks) + np.arange(begins[-1])
        after = np.minimum(at + 1, np.repeat(first[1:] - 1, chunks))
        winner = np.where(largest[at] >= largest[after], at[:, None], after[:, None])
        filters = np.broadcast_to(np.arange(FILTERS), winner.shape)
        where = winner * BLOCK + place[winner, filters]
        table = np.zeros_like(self.table)
        for j in range(WIDTH):
            np.add.at(table[j], (symbols[where + j].ravel(), filters.ravel()), down.ravel())
        table[:, PAD] = 0
        return [table, down.sum(axis=0), (error[:, None] * found).sum(axis=0), np.array([error.sum()], np.float32)]

    def train(self, texts: list[bytes], target: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
        """Adam over shuffled batches; the rate falls to a tenth."""
        rng = np.random.default_rng(seed)
        held = [self.table, self.bias, self.weight, self.offset]
        self.offset[0] = np.log(target.mean() / (1 - target.mean()))
        one, two, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
        lengths = np.array([len(t) for t in texts])
        orders = [rng.permutation(len(texts)) for _ in range(epochs)]
        batches = [chosen for order in orders for chosen in _batches(order, lengths)]
        total = len(batches)
        for chosen in batches:
            part = [texts[i] for i in chosen.tolist()]
            buf = np.frombuffer(b"".join(part), np.uint8)
            step += 1
            rate = RATE * 0.1 ** (step / total)
            for p, m, v, g in zip(held, one, two, self.gradients(buf, np.cumsum([0, *map(len, part)]), target[chosen]), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7) + DECAY * p)
        return self


def _batches(order: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """At most BATCH texts in a row, fewer where BATCH_BYTES are reached."""
    low = held = 0
    for k, i in enumerate(order.tolist()):
        held += int(lengths[i])
        if k + 1 - low == BATCH or held >= BATCH_BYTES or k + 1 == len(order):
            yield order[low : k + 1]
            low, held = k + 1, 0


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", learn: Column | None = None, documents: int = TRAIN_DOCUMENTS) -> bytes:
    """A network trained on labelled rows of `docs` for which `learn` (over doc_id) holds, pickled."""
    told = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).select("doc_id", F.col(target).alias("label"))
    if learn is not None:
        told = told.where(learn)
    told = told.groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label")).where("label <> 0.5")
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    chosen = chosen.select(F.col("doc_id").alias("labelled"), (F.col("label") > 0.5).cast("int").alias("label"))
    # at most `documents` rows of two numbers
    short = docs.where(F.col("text").isNull() | (F.octet_length("text") <= TRAIN_TEXT))
    rows = short.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, target, held = [], [], 0
        for batch in batches:
            for t, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if held + len(t or b"") <= TRAIN_BYTES:
                    texts.append(t or b"")
                    target.append(label)
                    held += len(texts[-1])
        target = np.array(target, np.float32)
        share = float(target.mean()) if len(target) else 0.5
        model = Network().train(texts, target) if 0 < share < 1 else share
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = rows.select("doc_id", "text", "label").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").mapInArrow(fit, "model binary").collect()
    return bytes(found[0]["model"]) if found else pickle.dumps(0.5)


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row of `docs`: doc_id and score, the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = pickle.loads(model)
        for batch in batches:
            buf, offsets = buffers(batch.column("text"))
            out = np.full(batch.num_rows, network if isinstance(network, float) else 0.5)
            low = 0
            while low < batch.num_rows and not isinstance(network, float):
                high = min(batch.num_rows, max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1))
                high = min(high, low + 256)
                out[low:high] = network.score(buf[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                low = high
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def assess(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score and predicted; fold 0 is held out of training."""
    model = train(docs, labels, learn=remainder(F.col("doc_id"), folds) != 0)
    held_out = remainder(F.col("doc_id"), folds) == 0
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
