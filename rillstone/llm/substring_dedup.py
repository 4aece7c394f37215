"""Substring dedup: words of passages that an earlier document also holds.

A window is ``WINDOW`` consecutive words. Each window has an anchor, the run of
``GRAM`` words in it with the least hash, and equal windows have equal anchors,
so a window need only be looked for among the windows of its anchor.

1. Consecutive windows with one anchor make a segment. Every document gives the
   hashes of its anchors and segments. Anchors of one document only are done
   with: this leaves the repeated passages.
2. Segments of a repeated anchor go to the anchor's shard, one text for all that
   equal the anchor's first. An anchor of more than ``HOT`` segments is split:
   its windows go to shards each by its own hash, equal ones merged before, so
   that no crowded anchor lands in one task.
3. A shard builds compressed FM-indexes of its segments and streams segments
   through them: backward search gives matching statistics, and the least
   document among the places of a whole window's match.
4. A document whose id is above that loses the window's words.

Words are compared by 48 bits of a 64-bit hash, a window thus by 13 of them.

Edge cases: null and empty texts have no words and lose none; so do documents
of fewer words than a window. Rows that share a doc_id don't count as earlier
than each other, and each gets its result. A null doc_id counts as larger than
all others. An empty table gives an empty result. A very long text is a piece of
its own, which takes some 30 times its bytes of a task's memory for a moment.
Extra columns are carried by `remove`, whatever their names, and ignored by
`assess`; `n_chars` follows its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.llm.columns import sheltered
from rillstone.llm.fm_index import FMIndex
from rillstone.llm.words import Words, buffers, mix, pieces, sample_once, scan, windows
from rillstone.runtime import row_key

WINDOW = 13
GRAM = 4
#: Windows of an anchor of more segments than this are dealt one by one; of at most MOST_HOT anchors.
HOT = 200
MOST_HOT = 50_000
#: Words that one FM-index holds, but for the last shard key in it.
INDEX_WORDS = 400_000
#: Distinct segments that a task remembers to merge equal ones.
MERGED = 100_000
_LARGEST = np.iinfo(np.int64).max
_CODE_BYTES = 6


def runs(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run of windows of one text with one anchor."""
    grams, width = windows(h, GRAM), WINDOW - GRAM + 1
    n = len(h) - WINDOW + 1
    none = np.zeros(0, np.int64)
    doc = words.doc
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :]) if n > 0 else none
    if not len(inside):
        return none, none, np.zeros(0, np.uint64)
    # least hash of the window's grams, by spans that double
    least, span = grams, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    best = least[inside]
    new = np.append(True, (best[1:] != best[:-1]) | (inside[1:] != inside[:-1] + 1))
    # a gram that repeats makes long runs: they are cut
    place = np.arange(len(inside))
    new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % width == 0
    firsts = np.flatnonzero(new)
    # 48 bits do: anchors that meet by chance cost time, no result, and zeros are shuffled for little
    return inside[firsts], np.diff(np.append(firsts, len(inside))), best[firsts] >> np.uint64(16)


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors of more than HOT segments, at most MOST_HOT, the most frequent: sorted hashes.

    Tasks count over all rows. Of the anchors that a task met once it gives a
    sixteenth, counted sixteen times, another one in each task: an anchor that
    many tasks hold once is found too. An anchor near the bound may be missed
    or taken for hot, which costs time but no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        salt = TaskContext.get().partitionId()

        def merged() -> tuple[np.ndarray, np.ndarray]:
            hashes, counts = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, counts = hashes[order], counts[order]
            at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
            counts, stays = sample_once(hashes[at], np.add.reduceat(counts, at) if len(at) else counts, salt)
            return hashes[at][stays], counts[stays]

        for _, buf, offsets in pieces(batches):
            words = scan(buf, offsets)
            hashes = runs(words, words.hashes())[2]
            held.append((hashes, np.ones(len(hashes), np.int64)))
            if sum(len(h) for h, _ in held) > 1_500_000:
                held = [merged()]
        if held:
            hashes, counts = merged()
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["anchor", "n"])

    counted = docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    most = counted.orderBy(F.desc("n"), "anchor").limit(MOST_HOT)
    return np.sort(np.array([r["anchor"] for r in most.toLocalIterator()], np.int64).view(np.uint64))


def _among(hashes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which hashes are among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(hashes), bool)
    return ordered[np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)] == hashes


def repeated_anchors(docs: DataFrame, hot: np.ndarray, ordered: bool) -> DataFrame:
    """(row, quiet, spoken): for each row its anchors that other rows hold too, but for the hot ones.

    Where rows are `ordered` as their documents, an anchor is quiet in rows whose
    segment is that of the anchor's first row: one text does for them. Rows that
    hold a hot anchor are there too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for part, buf, offsets in pieces(batches):
            words = scan(buf, offsets)
            h = words.hashes()
            at, n, hashes = runs(words, h)
            if not len(at):
                continue
            doc = np.searchsorted(words.first, at, "right") - 1
            rows = part.column("row").to_numpy(zero_copy_only=False)
            crowded = _among(hashes, hot)
            if crowded.any():
                some = rows[np.unique(doc[crowded])]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(some), pa.nulls(len(some), pa.int64())], ["anchor", "row", "name"])
            at, n, hashes, doc = at[~crowded], n[~crowded], hashes[~crowded], doc[~crowded]
            names = _segment_names(h, at, n + WINDOW - 1) >> np.uint64(16)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(rows[doc]), pa.array(names.view(np.int64))], ["anchor", "row", "name"])

    def judged(rows: pa.Table) -> pa.RecordBatch:
        """Of whole groups, sorted by anchor and row, those of several rows."""
        anchor, row, name = (rows.column(c).to_numpy() for c in ("anchor", "row", "name"))
        firsts = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        sizes = np.diff(np.append(firsts, len(anchor)))
        several = np.repeat(row[firsts] != row[firsts + sizes - 1], sizes)
        speaks = (not ordered) | (row == np.repeat(row[firsts], sizes)) | (name != np.repeat(name[firsts], sizes))
        return pa.RecordBatch.from_arrays([pa.array(row[several]), pa.array(anchor[several]), pa.array(speaks[several])], ["row", "anchor", "speaks"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            crowded = batch.filter(batch.column("anchor").is_null())
            if crowded.num_rows:
                yield pa.RecordBatch.from_arrays([crowded.column("row"), crowded.column("anchor"), pa.nulls(crowded.num_rows, pa.bool_())], ["row", "anchor", "speaks"])
                batch = batch.filter(batch.column("anchor").is_valid())
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            end = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if end:
                yield judged(table.slice(0, end))
                held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield judged(pa.Table.from_batches(held))

    emitted = docs.select("row", "text").mapInArrow(emit, "anchor long, row long, name long")
    dealt = emitted.repartition(F.coalesce("anchor", "row")).sortWithinPartitions("anchor", "row")
    found = dealt.mapInArrow(gather, "row long, anchor long, speaks boolean")
    return found.groupBy("row").agg(F.collect_list(F.when(~F.col("speaks"), F.col("anchor"))).alias("quiet"), F.collect_list(F.when(F.col("speaks"), F.col("anchor"))).alias("spoken"))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), np.diff(offsets))


_OCCURRENCE = "segment long, row long, place int, owner long"
_TEXT = "shard long, segment long, owner long, codes binary"


def squeezed(docs: DataFrame) -> DataFrame:
    """`docs` with texts compressed one by one: two thirds of what a shuffle makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                small = pa.array([None if t is None else encoder.compress(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([small if n == "text" else part.column(n) for n in part.schema.names], part.schema.names)

    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema])
    return docs.mapInArrow(run, schema)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their texts' bytes as they were."""
    decoder = zstandard.ZstdDecompressor()
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            texts = pa.array([None if t is None else decoder.decompress(t) for t in part.column("text").to_pylist()], pa.large_binary())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else part.column(n) for n in part.schema.names], part.schema.names)


def segments(docs: DataFrame, repeated: DataFrame, hot: np.ndarray, texts: bool) -> DataFrame:
    """Occurrences, or texts, of the segments of repeated anchors; `docs` as `squeezed` gives them.

    An occurrence is of `segment`, at the word `place` of `row`, whose order is
    `owner`. A text is a segment's codes, with the least owner that this task
    saw; the least owner of all speaks for a segment that is its anchor's first.
    """

    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, list] = {}

        def merged() -> pa.RecordBatch:
            columns = list(zip(*((s, k, o, c) for k, (s, o, c) in told.items()), strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            told.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "segment", "owner", "codes"])

        for part, buf, offsets in pieces(_restored(batches)):
            words = scan(buf, offsets)
            h = words.hashes()
            at, n, hashes = runs(words, h)
            doc = np.searchsorted(words.first, at, "right") - 1
            # mark runs whose (text, anchor) is asked for
            asked = mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            chosen = []
            for column in ("quiet", "spoken"):
                values, rows = _flat(part.column(column))
                chosen.append(np.isin(asked, mix(values.view(np.uint64) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
            hot = _among(hashes, sent.value)
            cold = (chosen[1] if texts else chosen[0] | chosen[1]) & ~hot
            # a hot run's windows are segments of their own
            each = np.where(hot, n, 1)[cold | hot]
            start = np.repeat(at[cold | hot], each)
            inner = np.arange(len(start)) - np.repeat(np.cumsum(each) - each, each)
            single = np.repeat(hot[cold | hot], each)
            start = start + np.where(single, inner, 0)
            size = np.where(single, 1, np.repeat(n[cold | hot], each)) + WINDOW - 1
            if not len(start):
                continue
            doc = np.searchsorted(words.first, start, "right") - 1
            ident = _segment_names(h, start, size).view(np.int64)
            owners = part.column("doc_id").cast(pa.int64()).fill_null(_LARGEST).to_numpy(zero_copy_only=False)[doc]
            if not texts:
                rows = part.column("__row").to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(ident), pa.array(rows), pa.array((start - words.first[doc]).astype(np.int32)), pa.array(owners)], ["segment", "row", "place", "owner"])
                continue
            raw = (h & np.uint64((1 << 8 * _CODE_BYTES) - 1)).view(np.uint8).reshape(-1, 8)[:, :_CODE_BYTES].tobytes()
            shard = np.where(single, ident, np.repeat(hashes[cold | hot].view(np.int64), each))
            for s, k, o, a, z in zip(*(c.tolist() for c in (shard, ident, owners, start, size)), strict=True):
                if (known := told.get(k)) is None:
                    told[k] = [s, o, raw[a * _CODE_BYTES : (a + z) * _CODE_BYTES]]
                elif o < known[1]:
                    known[1] = o
            if len(told) > MERGED:
                yield merged()
        if told:
            yield merged()

    joined = docs.join(repeated.withColumnRenamed("row", "__row"), "__row").select("__row", "doc_id", "quiet", "spoken", "text")
    return joined.mapInArrow(run, _TEXT if texts else _OCCURRENCE)


def _segment_names(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the `size` words from each start; sizes differ by few."""
    out = np.zeros(len(start), np.uint64)
    for z in np.unique(size).tolist():
        some = size == z
        at = start[some]
        value = np.full(len(at), z, np.uint64)
        for j in range(z):
            value = mix(value * np.uint64(0xD6E8FEB86659FD93) + h[at + j])
        out[some] = value
    return out


def search_shards(texts: DataFrame) -> DataFrame:
    """(segment, owners): for each window of a segment the least owner of the same words in its shard."""

    def index(block: pa.Table) -> pa.RecordBatch:
        # equal segments of several tasks meet here, the least owner first
        segment = block.column("segment").to_numpy()
        block = block.filter(pa.array(np.append(True, segment[1:] != segment[:-1])))
        raw, offsets = buffers(block.column("codes"))
        wide = np.zeros((len(raw) // _CODE_BYTES, 8), np.uint8)
        wide[:, :_CODE_BYTES] = raw.reshape(-1, _CODE_BYTES)
        codes, bounds = wide.view(np.uint64).ravel(), offsets // _CODE_BYTES
        owners = block.column("owner").to_numpy()
        _, least = FMIndex(codes, bounds, owners, WINDOW).matches(codes, bounds)
        # a segment's last WINDOW - 1 places begin no window
        count = np.diff(bounds) - WINDOW + 1
        flat = np.repeat(bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(least[flat]))
        return pa.RecordBatch.from_arrays([block.column("segment").combine_chunks(), lists], ["segment", "owners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("codes").nbytes // _CODE_BYTES
            if size < INDEX_WORDS:
                continue
            # rows come sorted by shard: the last shard may go on in the next batch
            block = pa.Table.from_batches(held)
            shard = block.column("shard").to_numpy()
            end = int(np.searchsorted(shard, shard[-1]))
            if end:
                yield index(block.slice(0, end))
            held = block.slice(end).combine_chunks().to_batches()
            size = sum(b.column("codes").slice(0).nbytes for b in held) // _CODE_BYTES if end else 0
        if held and sum(b.num_rows for b in held):
            yield index(pa.Table.from_batches(held))

    named = texts.repartition("shard").sortWithinPartitions("shard", "segment", "owner")
    return named.mapInArrow(run, "segment long, owners array<long>")


def removed_windows(docs: DataFrame, small: DataFrame, ordered: bool) -> DataFrame:
    """(row, windows): for each row that loses words its (place, mask); `docs` has row, doc_id, text, and
    `small` is it squeezed, with the row as __row.

    Bit i of a mask is set where the window i words after `place` is an earlier document's too.
    """
    hot = hot_anchors(docs)
    repeated = repeated_anchors(docs, hot, ordered)
    judged = segments(small, repeated, hot, texts=False).join(search_shards(segments(small, repeated, hot, texts=True)), "segment")
    bits = F.transform("owners", lambda x, i: F.when(x < F.col("owner"), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    mask = F.aggregate(bits, F.lit(0).cast("long"), lambda total, x: total + x)
    judged = judged.select("row", F.struct("place", mask.alias("mask")).alias("window")).where("window.mask != 0")
    return judged.groupBy("row").agg(F.collect_list("window").alias("windows"))


def _covered(words: Words, windows_column: pa.Array) -> np.ndarray:
    """Which words the removed windows cover."""
    covered = np.zeros(len(words) + 1, np.int64)
    if isinstance(windows_column, pa.ChunkedArray):
        windows_column = windows_column.combine_chunks()
    values = windows_column.flatten()
    lengths = np.diff(windows_column.offsets.to_numpy())
    lengths[windows_column.is_null().to_numpy(zero_copy_only=False)] = 0
    doc = np.repeat(np.arange(len(windows_column)), lengths)
    place = values.field("place").to_numpy(zero_copy_only=False).astype(np.int64)
    mask = values.field("mask").to_numpy(zero_copy_only=False).astype(np.int64)
    for bit in range(WINDOW):
        at = (words.first[doc] + place)[mask >> bit & 1 == 1] + bit
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0


def _with_windows(docs: DataFrame) -> DataFrame:
    """`docs`, squeezed, with __windows: the removed windows of each row, null where it loses nothing."""
    repeats = not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    # ids that are unique serve as keys; else equal rows share one, and one of them is searched
    rows = docs.withColumn("__row", row_key("doc_id", "text") if repeats else F.col("doc_id").cast("long"))
    # keys are never null; saying so lets both joins read one exchange of the texts
    small = squeezed(rows).where("__row is not null")
    plain, sent = rows.select("doc_id", "text", F.col("__row").alias("row")), small.select("doc_id", "text", "__row")
    if repeats:
        plain, sent = plain.dropDuplicates(["row"]), sent.dropDuplicates(["__row"])
    found = removed_windows(plain, sent, ordered=not repeats)
    found = found.select(F.col("row").alias("__found"), F.col("windows").alias("__windows"))
    return small.join(found, F.col("__row") == F.col("__found"), "left").drop("__row", "__found")


def assess(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed and kept, its kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in pieces(_restored(batches)):
            words = scan(buf, offsets)
            gone = _covered(words, part.column("__windows"))
            removed = np.append(0, np.cumsum(gone))
            kept = words.joined(~gone)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(words.counts), pa.array(removed[words.first[1:]] - removed[words.first[:-1]]), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return _with_windows(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def remove(docs: DataFrame) -> DataFrame:
    """`docs` without the removed words: white space beside what stays is kept.

    Documents that lose all their words go. `n_chars`, where there, follows.
    """
    rows = sheltered(docs)
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in pieces(_restored(batches)):
            words = scan(buf, offsets)
            gone = _covered(words, part.column("__windows"))
            first, texts, stays = words.first.tolist(), [], []
            for i, (low, high) in enumerate(zip(first, first[1:], strict=False)):
                lost = gone[low:high]
                stays.append(not (high > low and lost.all()))
                if not lost.any() or not stays[-1]:
                    texts.append(None if (t := part.column("text")[i].as_py()) is None else t.decode("utf-8", "replace"))
                    continue
                # cut from a lost word's start to the next kept word's, or to the end
                keep = np.ones(int(offsets[i + 1] - offsets[i]), np.int8)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    end = words.starts[low + b] if low + b < high else offsets[i + 1]
                    keep[words.starts[low + a] - offsets[i] : end - offsets[i]] = 0
                texts.append(buf[offsets[i] : offsets[i + 1]][keep.astype(bool)].tobytes().decode("utf-8", "replace"))
            columns = [pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(stays, pa.bool_()))

    out = _with_windows(rows).mapInArrow(run, schema)
    out = out.withColumn("n_chars", F.length("text").cast(dict(rows.dtypes)["n_chars"])) if "n_chars" in rows.columns else out
    return out.toDF(*docs.columns)
