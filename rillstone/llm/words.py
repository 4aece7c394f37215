"""Words of Arrow text columns as numpy arrays.

A whole batch is scanned at once: bytes are classed by a lookup table, word
borders are where the class changes, and words are hashed eight bytes at a
time. Batches are cut into pieces of about
``PIECE_BYTES`` of text, so memory stays flat however many rows arrive; a
single longer text is a piece of its own.

Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

#: Bytes of words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

#: The low bytes of a 64-bit word, by how many count.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts: `first[i]:first[i + 1]` are those of text i."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight at a time."""
        held = np.zeros(len(self.buf) + 8, np.uint8)
        held[: len(self.buf)] = self.buf
        eights = np.lib.stride_tricks.as_strided(held, (len(self.buf) + 1, 8), (1, 1))

        def bytes_at(at: np.ndarray, left: np.ndarray) -> np.ndarray:
            return eights[at].view("<u8").ravel() & _LOW_BYTES[np.minimum(left, 8)]

        left = self.ends - self.starts
        h = mix(bytes_at(self.starts, left) + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        longer = np.flatnonzero(left > 8)
        at, left = self.starts[longer] + 8, left[longer] - 8
        while len(longer):
            h[longer] = mix(h[longer] * np.uint64(0xD6E8FEB86659FD93) + bytes_at(at, left))
            more = left > 8
            longer, at, left = longer[more], at[more] + 8, left[more] - 8
        return h

    def text(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Per text its kept words, joined by one space."""
        chosen = np.flatnonzero(keep)
        starts, ends = self.starts[chosen], self.ends[chosen]
        lengths = ends - starts + 1
        out = np.full(int(lengths.sum()), 0x20, np.uint8)
        at = np.cumsum(lengths) - lengths
        # each kept byte's place: its word's start, less the places before it
        source = np.arange(len(out)) + np.repeat(starts - at, lengths)
        inner = np.ones(len(out), bool)
        inner[at + lengths - 1] = False
        out[inner] = self.buf[source[inner]]
        kept_before = np.searchsorted(chosen, self.first)
        bounds = np.append(at, len(out))[kept_before]
        raw = out.tobytes()
        return [raw[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def scan(buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = SPACED, lower: bool = False) -> Words:
    """The words of the texts `buf[offsets[i]:offsets[i + 1]]`; offsets begin at 0."""
    if lower:
        buf = _LOWER[buf]
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = word_bytes[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = np.zeros(len(buf) + 1, bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    borders = offsets[1:-1]
    begins[borders] = inside[borders]  # a text's first byte never continues the text before it
    after = borders[borders > 0]
    ends[after] = inside[after - 1]
    starts = np.flatnonzero(begins)
    return Words(buf, starts, np.flatnonzero(ends), np.searchsorted(starts, offsets))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each place on; shorter by k - 1 than `h`."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
    return mix(out)


def sample_once(values: np.ndarray, counts: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and which values stay: of those counted once a sixteenth, counted sixteen times, another one for each salt."""
    once = counts == 1
    drawn = mix(values.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & ((1 << 64) - 1))) & np.uint64(15) == 0
    return np.where(once, 16, counts), ~once | drawn


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, one text after another, and the texts' offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset_buffer, data = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about PIECE_BYTES of text each: rows, bytes, offsets."""
    for batch in batches:
        buf, offsets = buffers(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(offsets, offsets[low] + PIECE_BYTES, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low), buf[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high
