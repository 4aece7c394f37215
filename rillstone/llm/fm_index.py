"""A compressed FM-index over integer texts.

The transform of all texts, joined by a separator, is held as a wavelet matrix:
one bit vector for each bit of a symbol, packed into 64-bit words, with a count
for each word and one for each 1024 words. A rank costs one look at a word and
its counts for each level. Searches go backward, a symbol at a time, for many
queries at once.

Suffixes are sorted by their first `threshold` symbols or a few more, which is
all that matching up to that length needs. Neither the texts nor the order of
the suffixes is kept: a match is shortened by the lengths of common prefixes of
neighbouring suffixes, at most `threshold`, four bits each, and the owner of a
whole match is held once for all suffixes that share it.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with rank."""

    def __init__(self, bits: np.ndarray):
        self.words = np.frombuffer(np.packbits(np.append(bits, np.zeros(64 + -len(bits) % 64, bool)), bitorder="little").tobytes(), np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        before = np.cumsum(counts) - counts
        self.blocks = before[::1024].astype(np.uint32)
        self.before = (before - np.repeat(before[::1024], 1024)[: len(before)]).astype(np.uint16)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.blocks.nbytes + self.before.nbytes

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` bits are set."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.blocks[word >> 10].astype(np.int64) + self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Symbols with rank: where occurrences of a symbol lie below the last level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.zeros = [], []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            self.levels.append((level, BitVector(bits)))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.last = symbols_key(symbols, levels)

    def begins(self, n_symbols: int) -> np.ndarray:
        """Where the run of each symbol begins; to be asked once, when the matrix has been made."""
        runs = np.searchsorted(self.last, symbols_key(np.arange(n_symbols), len(self.levels)))
        del self.last
        return runs

    @property
    def nbytes(self) -> int:
        return sum(bits.nbytes for _, bits in self.levels)

    def places(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run's place that each symbol's occurrences before `low`, and before `high`, reach to."""
        both, n = np.concatenate([low, high]), len(low)
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one = (symbol >> level & 1).astype(bool)
            ranked = bits.ones(both)
            both = np.where(np.concatenate([one, one]), zeros + ranked, both - ranked)
        return both[:n], both[n:]


def symbols_key(symbols: np.ndarray, levels: int) -> np.ndarray:
    """Symbols in the order that the last level holds them: by their bits reversed."""
    key = np.zeros(len(symbols), np.int64)
    for level in range(levels):
        key = key << 1 | (symbols >> level & 1)
    return key


class FMIndex:
    """Index of texts, given as one array of codes of at most 48 bits with the texts' bounds, and an owner for each text."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, owners: np.ndarray, threshold: int):
        self.threshold = threshold
        alphabet, ids = np.unique(codes, return_inverse=True)
        # sorted codes in six bytes each: what a code is told by
        self.upper, self.lower = (alphabet >> np.uint64(16)).astype(np.uint32), alphabet.astype(np.uint16)
        n_texts = len(bounds) - 1
        # one separator, symbol 0, follows each text
        lengths = np.diff(bounds)
        places = np.arange(len(codes)) + np.repeat(np.arange(n_texts), lengths)
        text = np.zeros(len(codes) + n_texts, np.int64)
        text[places] = ids + 1
        self.n = len(text)
        order = self._sorted_suffixes(text, threshold)
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(len(alphabet)).bit_length()))
        # from a place in a symbol's run to that of the suffix that the symbol makes longer
        less = np.cumsum(np.append(0, np.bincount(text, minlength=len(alphabet) + 1)))[:-1]
        self.offset = (less - self.wavelet.begins(len(alphabet) + 1)).astype(np.int32)
        # common prefixes of neighbours, two to a byte
        shared = np.zeros(self.n + self.n % 2, np.uint8)
        alike = np.ones(max(0, self.n - 1), bool)
        for depth in range(min(threshold, 15)):
            moved = text[(order + depth) % self.n]
            alike &= moved[1:] == moved[:-1]
            shared[1 : self.n][alike] = depth + 1
        self.shared = shared[::2] | shared[1::2] << np.uint8(4)
        # the least owner among suffixes that share their first `threshold` symbols, where these are of one text
        whole = np.zeros(self.n, bool)
        whole[places] = np.repeat(bounds[1:], lengths) - np.arange(len(codes)) >= threshold
        begins = np.append(True, ~alike) if self.n else np.zeros(0, bool)
        firsts = np.flatnonzero(begins)
        self.owners, which = np.unique(owners, return_inverse=True)
        held = np.repeat(which, lengths + 1)[order]
        least = np.minimum.reduceat(held, firsts) if self.n else held
        kept = whole[order[firsts]]
        begins[firsts[~kept]] = False
        self.groups, self.least = BitVector(begins), least[kept].astype(np.uint16 if len(self.owners) <= 1 << 16 else np.uint32)

    @property
    def nbytes(self) -> int:
        """Bytes that searching reads."""
        return self.wavelet.nbytes + self.groups.nbytes + sum(a.nbytes for a in (self.upper, self.lower, self.offset, self.shared, self.owners, self.least))

    @staticmethod
    def _sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Places of the cyclic suffixes by their first `depth` symbols at least."""
        # as many symbols as fit one key begin; each round doubles them
        bits = max(1, int(text.max(initial=0)).bit_length())
        known = max(1, min(depth, 62 // bits))
        key = text.copy()
        for i in range(1, known):
            key = key << bits | np.roll(text, -i)
        order = np.argsort(key)
        while known < depth:
            ordered = key[order]
            rank = np.empty_like(text)
            rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -known)
            order = np.argsort(key)
            known *= 2
        return order

    def common(self, at: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at these places share with those before them, at most `threshold`."""
        return self.shared[at >> 1] >> (at & 1).astype(np.uint8) * np.uint8(4) & np.uint8(15)

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of codes of 48 bits; -1 for those that the index doesn't hold."""
        if not len(self.upper):
            return np.full(len(codes), -1)
        upper, lower = (codes >> np.uint64(16)).astype(np.uint32), codes.astype(np.uint16)
        at = np.minimum(np.searchsorted(self.upper, upper), len(self.upper) - 1)
        while True:
            # of codes that agree in their upper bits the lower ones decide
            later = (self.upper[at] == upper) & (self.lower[at] < lower) & (at < len(self.upper) - 1)
            if not later.any():
                break
            at = at + later
        return np.where((self.upper[at] == upper) & (self.lower[at] == lower), at + 1, -1)

    def matches(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of queries, and owners.

        For each place: the length, at most `threshold`, of the longest match
        that begins there within its query, and where that is `threshold` the
        least owner of a text with the same symbols; else the largest integer.
        """
        symbols = self.symbols(codes)
        length = np.zeros(len(codes), np.int64)
        owner = np.full(len(codes), np.iinfo(np.int64).max)
        at = bounds[1:] - 1
        query = np.flatnonzero(at >= bounds[:-1])
        low, high, depth = np.zeros(len(at), np.int64), np.full(len(at), self.n), np.zeros(len(at), np.int64)
        while len(query):
            place = at[query]
            symbol = symbols[place]
            self._widen(query[depth[query] == self.threshold], low, high, depth)
            gone = query[symbol < 0]
            low[gone], high[gone], depth[gone] = 0, self.n, 0
            trying = query[symbol >= 0]
            while len(trying):
                s = symbols[at[trying]]
                a, b = self.wavelet.places(s, low[trying], high[trying])
                found = b > a
                done = trying[found]
                offset = self.offset[s]
                low[done], high[done] = (offset + a)[found], (offset + b)[found]
                depth[done] += 1
                trying = trying[~found]
                trying = trying[depth[trying] > 0]
                self._widen(trying, low, high, depth)
            length[place] = depth[query]
            whole = query[depth[query] == self.threshold]
            owner[at[whole]] = self.owners[self.least[self.groups.ones(low[whole] + 1) - 1]]
            at[query] -= 1
            query = query[at[query] >= bounds[query]]
        return length, owner

    def _widen(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> None:
        """Drops the last symbol of these queries' matches: takes in the neighbours that share all others."""
        depth[queries] = np.maximum(depth[queries] - 1, 0)
        empty = queries[depth[queries] == 0]
        low[empty], high[empty] = 0, self.n
        some = queries[depth[queries] > 0]
        down = up = some
        while len(down):
            down = down[low[down] > 0]
            down = down[self.common(low[down]) >= depth[down]]
            low[down] -= 1
        while len(up):
            up = up[high[up] < self.n]
            up = up[self.common(high[up]) >= depth[up]]
            high[up] += 1
