"""Packing of tokenised documents into sequences of bounded length.

`pieces` tokenises each document and cuts it; `pack` deals the pieces to groups
of about ``GROUP_PIECES`` rows (slim rows: no text, no ids) and packs each group
on its own, so a group costs at most its last sequence. A piece of full length
is a sequence already and isn't dealt.

A group is first packed best fit, longest first. While it has more sequences
than its tokens need, local search takes the emptiest one and trades with the
other underfull ones: a document moves, or is exchanged for a shorter one, or
two are exchanged for one. Each trade raises the sum of squared fills, so the
search ends; a sequence that has lost all its documents is gone.

Edge cases: a null or empty text is one piece that holds the end id alone.
Repeated rows are packed each. Null ids of documents are carried. Of equally
good places for a piece the first made is taken. An empty table gives an empty
result. A very long text is encoded whole, some 100 times its bytes in a task's
memory for a moment. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.runtime import cut

LENGTH = 1024
END_ID = 2
GROUP_PIECES = 50_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[tuple, object] = {}


class Encoder:
    """Ids by the library `tokenizers`; by `tiktoken` where both are sure to agree.

    `ranks_path` holds the vocabulary of `tokenizer_path` as ranks. Texts with
    the string of a special token, or characters outside Latin and general
    punctuation, which the two libraries might class otherwise, always go to
    `tokenizers`.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_path)
        self.quick = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            special = [re.escape(t.content) for t in self.slow.get_added_tokens_decoder().values()]
            self.unsure = re.compile("|".join([*special, r"[^\t\n\r\x20-\x7e\u00a0-\u024f\u2010-\u2027]"]))

    def ids(self, text: str) -> np.ndarray:
        if self.quick is not None and not self.unsure.search(text):
            return np.asarray(self.quick.encode_to_numpy(text, disallowed_special=()), "<u4")
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(*args) -> Encoder:
    """One encoder for each process."""
    if args not in _loaded:
        _loaded[args] = Encoder(*args)
    return _loaded[args]


def public_encoder_args() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cuts(total: int, length: int = LENGTH) -> list[int]:
    """Where the pieces of a document of `total` ids begin, and its end: only the first may be shorter."""
    if total <= length:
        return [0, total]
    short = total % length
    return [*([0] if short else []), *range(short, total + 1, length)]


def pieces(docs: DataFrame, encoder_args: tuple | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document."""
    args = encoder_args or public_encoder_args()
    schema = _PIECES + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*args)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out: list[tuple] = []
                held = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode.ids(text or ""), np.uint32(end_id)).astype("<u4")
                    at = cuts(len(ids), length)
                    raw = memoryview(ids.tobytes())
                    for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                        out.append((doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
                        if with_ids:
                            held.append(ids[a:b].tolist())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of places in `lengths`, longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r: some bin has exactly r left
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > need:
            by_room[room - need].append(b)
            rooms |= 1 << (room - need)
    return bins


def best_trade(source: list[int], target: list[int], lengths: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """What `source` gives and gets so that `target` gains most, but no more than `room`."""
    best, found = 0, None
    take = [([], 0), *(([y], lengths[y]) for y in target)]
    give = [([x], lengths[x]) for x in source]
    give += [([x, z], lengths[x] + lengths[z]) for k, x in enumerate(source) for z in source[:k]]
    for g, n in give:
        for t, m in take:
            if len(g) == 2 and not t:
                continue  # two moves do the same
            if best < n - m <= room:
                best, found = n - m, (g, t)
    return found


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins after trades that raise the sum of squared fills, until no emptiest bin can be emptied."""
    least = -(-sum(lengths) // capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    full = [b for b, f in zip(bins, fill, strict=True) if f == capacity]
    under = sorted((f, b) for f, b in zip(fill, bins, strict=True) if f < capacity)
    while under and len(full) + len(under) > least:
        _, source = under.pop(0)
        source, others, before = list(source), [(f, list(b)) for f, b in under], len(under)
        for k in range(len(others) - 1, -1, -1):
            f, target = others[k]
            while source and f < capacity and (trade := best_trade(source, target, lengths, capacity - f)):
                g, t = trade
                # a target fuller than the source gains: the sum of squares rises
                source = [x for x in source if x not in g] + t
                target = [y for y in target if y not in t] + g
                f = sum(lengths[i] for i in target)
                others[k] = (f, target)
            if not source:
                break
        full += [b for f, b in others if f == capacity]
        under = sorted((f, b) for f, b in others if f < capacity)
        if source:
            under = sorted([*under, (sum(lengths[i] for i in source), source)])
            if len(under) > before - 1 and not any(f < capacity // 2 for f, _ in under[1:]):
                break
    return full + [b for _, b in under]


def pack(found: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`found` (as from `pieces`) with sequence_id and offset."""
    found = cut(found)
    whole = found.where(F.col("length") == length).withColumns({"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("long")})
    rest = found.where(F.col("length") != length)
    groups = max(1, -(-rest.count() // group_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        group = rows.column("group")[0].as_py()
        lengths = rows.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n, b in enumerate(local_search(best_fit(lengths, length), lengths, length)):
            at = 0
            for i in b:
                sequence[i], offset[i] = ((group << 32) + n) * 2 + 1, at
                at += lengths[i]
        rows = rows.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from rows.to_batches(max_chunksize=10_000)

    schema = found.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"
    dealt = rest.repartition(groups).withColumn("group", F.spark_partition_id().cast("long"))
    return whole.unionByName(dealt.mapInArrow(run, schema))


def pack_documents(docs: DataFrame, encoder_args: tuple | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents as pieces in sequences: the columns of `pieces`, then sequence_id and offset."""
    return pack(pieces(docs, encoder_args, length, end_id, with_ids), length)
