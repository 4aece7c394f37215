"""N-gram Jaccard join: documents whose sets of five-word shingles are 0.8 alike.

1. Equal sets are one class, named by a 64-bit hash of the set.
2. Two sets that are 0.8 alike share one of their first fifth of tokens, by any
   order of tokens that holds for all sets. The order is by hash, but the
   tokens that most classes begin with come last. Classes that share such a
   token form a group, named by the least class that has the token.
3. Signature trees of each group, of bitmaps alone, leave few pairs; what they
   connect is a cluster.
4. Signature trees of each cluster, over its texts, confirm links exactly.
5. The components of the confirmed links are the result.

A group or cluster beyond a bound of tokens is split into blocks, each with the
least member; members that a block doesn't connect with it are then held
against every block. So no group has to fit in one task, and none is cut short.
Groups of copies never give all their pairs: a pair that is connected already
isn't looked at.

Edge cases: a document with no words or no text has an empty set and is linked
with nothing; one of fewer than five words has its whole sequence as its one
shingle. Repeated rows have equal sets. A null doc_id is the largest of all; a
component of such rows alone has a null id. Of equal smallest ids `keep_one`
keeps one row. An empty table gives an empty result. A very long text is a piece
of its own: its set takes some 30 times its bytes of a task's memory for a
moment. Extra columns are carried by `keep_one`, whatever their names, and
ignored by `assess`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.llm.columns import sheltered
from rillstone.llm.components import components
from rillstone.llm.signature_tree import Forest, links, signature
from rillstone.llm.words import SPACED, mix, pieces, sample_once, scan, windows
from rillstone.runtime import cut, row_key

SHINGLE = 5
#: Tokens that more classes than this begin with come last in the order, at most MOST_HOT of them.
HOT = 64
MOST_HOT = 50_000
#: Tokens that one task holds of a group, or of a cluster.
GROUP_TOKENS = 1 << 22
CLUSTER_TOKENS = 1 << 20
#: Ids of removed documents of at most this number, 16 MB, are broadcast.
BROADCAST_IDS = 1_000_000
_LARGEST = np.iinfo(np.int64).max


@dataclass
class Sets:
    """Token sets of several texts, each sorted: `tokens[first[i]:first[i + 1]]`."""

    tokens: np.ndarray
    first: np.ndarray
    name: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.sizes)

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.first[i] : self.first[i + 1]]


def _by_owner(tokens: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """The order by owner, then token: one sort of a key of both, if that tells all tokens apart."""
    if owners < 1 << 16:
        key = owner.astype(np.uint64) << np.uint64(48) | tokens >> np.uint64(16)
        order = np.argsort(key)
        key, ordered = key[order], tokens[order]
        if not ((key[1:] == key[:-1]) & (ordered[1:] < ordered[:-1])).any():
            return order
    return np.lexsort((tokens, owner))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> Sets:
    """The sets of shingles of texts."""
    words = scan(buf, offsets, SPACED, lower=True)
    h, doc, count = words.hashes(), words.doc, words.counts
    tokens = windows(h, SHINGLE)
    inside = np.flatnonzero(doc[: len(tokens)] == doc[SHINGLE - 1 :]) if len(tokens) else np.zeros(0, np.int64)
    tokens, owner = tokens[inside], doc[inside]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        whole = [mix(windows(h[words.first[i] : words.first[i + 1]], int(count[i])) + np.uint64(count[i]))[0] for i in short.tolist()]
        tokens, owner = np.append(tokens, np.array(whole, np.uint64)), np.append(owner, short)
    order = _by_owner(tokens, owner, len(count))
    tokens, owner = tokens[order], owner[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])) if len(tokens) else np.zeros(0, bool)
    tokens, owner = tokens[new], owner[new]
    sizes = np.bincount(owner, minlength=len(count))
    first = np.append(0, np.cumsum(sizes))
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D))))
    return Sets(tokens, first, mix(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64)).view(np.int64))


def needed(n: np.ndarray) -> np.ndarray:
    """How many tokens of a set of n, in order, hold one of any set 0.8 alike."""
    return n - (4 * n + 4) // 5 + 1


def classes_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, class) of each row of `docs`, which has a column `row` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offsets in pieces(batches):
            sets = shingle_sets(buf, offsets)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(sets.sizes), pa.array(sets.name)], ["row", "doc_id", "n", "class"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {dict(docs.dtypes)['doc_id']}, n long, class long")


def _fresh(sets: Sets, seen: set[int]) -> np.ndarray:
    """Which texts hold a class that the task hasn't met; a long task may meet one again."""
    fresh = np.zeros(len(sets.name), bool)
    if len(seen) > 500_000:
        seen.clear()
    for i, (name, n) in enumerate(zip(sets.name.tolist(), sets.sizes.tolist(), strict=True)):
        if n and name not in seen:
            seen.add(name)
            fresh[i] = True
    return fresh


def _prefixes(sets: Sets, fresh: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the prefixes, their texts, and whether each is hot."""
    doc, tokens = sets.doc, sets.tokens
    keep = fresh[doc]
    doc, tokens = doc[keep], tokens[keep]
    crowded = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens if len(hot) else np.zeros(len(tokens), bool)
    if crowded.any():
        order = np.lexsort((tokens, crowded, doc))
        doc, tokens, crowded = doc[order], tokens[order], crowded[order]
    begins = np.searchsorted(doc, np.arange(len(sets.name)))
    rank = np.arange(len(doc)) - begins[doc]
    early = rank < needed(sets.sizes)[doc]
    return tokens[early], doc[early], crowded[early]


def hot_tokens(docs: DataFrame, hot: int = HOT) -> dict[int, int]:
    """Tokens that many classes begin with, and the least such class: at most MOST_HOT, the most frequent.

    Tasks count over all rows. Of the tokens that a task met once it gives a
    sixteenth, counted sixteen times, another one in each task: a token that
    many tasks hold once is found too. A token near the bound may be missed or
    taken for hot, which costs time but no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        salt = TaskContext.get().partitionId()

        def merge() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            tokens, counts, least = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(tokens, kind="stable")
            tokens, counts, least = tokens[order], counts[order], least[order]
            at = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
            counts, least, tokens = (np.add.reduceat(counts, at), np.minimum.reduceat(least, at), tokens[at]) if len(at) else (counts, least, tokens)
            counts, stays = sample_once(tokens, counts, salt)
            return tokens[stays], counts[stays], least[stays]

        for _, buf, offsets in pieces(batches):
            sets = shingle_sets(buf, offsets)
            tokens, doc, _ = _prefixes(sets, _fresh(sets, seen), np.zeros(0, np.uint64))
            held.append((tokens, np.ones(len(tokens), np.int64), sets.name[doc]))
            if sum(len(t) for t, _, _ in held) > 1_500_000:
                held = [merge()]
        if held:
            tokens, counts, least = merge()
            for low in range(0, len(tokens), 100_000):
                part = slice(low, low + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(tokens[part].view(np.int64)), pa.array(counts[part]), pa.array(least[part])], ["token", "n", "least"])

    counted = docs.select("text").mapInArrow(run, "token long, n long, least long")
    most = counted.groupBy("token").agg(F.sum("n").alias("n"), F.min("least").alias("least")).where(F.col("n") > hot).orderBy(F.desc("n"), "token").limit(MOST_HOT)
    return {r["token"]: r["least"] for r in most.toLocalIterator()}


def grouped(docs: DataFrame, crowded: dict[int, int]) -> DataFrame:
    """(group, class): classes that share a token of their prefixes, groups of two or more."""
    hot = np.sort(np.array(list(crowded), np.int64).view(np.uint64)) if crowded else np.zeros(0, np.uint64)
    names = np.array([crowded[t] for t in hot.view(np.int64).tolist()], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((hot, names))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, names = sent.value
        seen: set[int] = set()
        for _, buf, offsets in pieces(batches):
            sets = shingle_sets(buf, offsets)
            tokens, doc, is_hot = _prefixes(sets, _fresh(sets, seen), hot)
            cold = ~is_hot
            yield pa.RecordBatch.from_arrays([pa.array(tokens[cold].view(np.int64)), pa.array(sets.name[doc[cold]]), pa.nulls(int(cold.sum()), pa.int64())], ["token", "class", "group"])
            if is_hot.any():
                group, name = names[np.searchsorted(hot, tokens[is_hot])], sets.name[doc[is_hot]]
                pairs = np.unique(np.stack([np.append(group, group), np.append(name, group)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[1]), pa.array(pairs[0])], ["token", "class", "group"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by token and class: a token's first class leads its group; rows of hot tokens, first, know theirs
        last_token, last_lead, last_class = None, 0, 0
        for batch in batches:
            given = batch.filter(batch.column("group").is_valid())
            if given.num_rows:
                yield given.select(["group", "class"])
            batch = batch.filter(batch.column("group").is_null())
            if not batch.num_rows:
                continue
            token, name = batch.column("token").to_numpy(), batch.column("class").to_numpy()
            new = np.append(token[0] != last_token, token[1:] != token[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            leads = np.where(at >= 0, name[np.maximum(at, 0)], last_lead)
            again = np.append(not new[0] and name[0] == last_class, ~new[1:] & (name[1:] == name[:-1]))
            other = (leads != name) & ~again
            last_token, last_lead, last_class = token[-1], int(leads[-1]), name[-1]
            if other.any():
                pairs = np.unique(np.stack([np.append(leads[other], leads[other]), np.append(name[other], leads[other])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["group", "class"])

    emitted = docs.select("text").mapInArrow(emit, "token long, class long, group long")
    dealt = emitted.repartition(F.coalesce("token", F.xxhash64("group", "class"))).sortWithinPartitions("token", "class")
    return dealt.mapInArrow(lead, "group long, class long").distinct()


def signatures(docs: DataFrame) -> DataFrame:
    """(class, n, payload): the bitmap of each class; a class may come from several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, buf, offsets in pieces(batches):
            sets = shingle_sets(buf, offsets)
            fresh = np.flatnonzero(_fresh(sets, seen))
            yield pa.RecordBatch.from_arrays([pa.array(sets.name[fresh]), pa.array(sets.sizes[fresh]), pa.array([signature(sets.of(i)).tobytes() for i in fresh.tolist()], pa.binary())], ["class", "n", "payload"])

    return docs.select("text").mapInArrow(run, "class long, n long, payload binary").dropDuplicates(["class"])


def _bitmap_links(n: np.ndarray, payloads: list[bytes], forest: Forest) -> list[tuple[int, int]]:
    return links(n, [np.frombuffer(p, np.uint64) for p in payloads], lambda x, y: True, forest)


def _text_links(n: np.ndarray, payloads: list[bytes], forest: Forest) -> list[tuple[int, int]]:
    offsets = np.append(0, np.cumsum([len(p) for p in payloads]))
    sets = shingle_sets(np.frombuffer(b"".join(payloads), np.uint8), offsets)
    sizes = sets.sizes

    def linked(x: int, y: int) -> bool:
        a, b = sets.of(x), sets.of(y)
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 100 * both >= 80 * (len(a) + len(b) - both)

    return links(sizes, [signature(sets.of(i)) for i in range(len(sizes))], linked, forest)


def link_groups(members: DataFrame, find: Callable, most_tokens: int) -> DataFrame:
    """Edges (a, b) that connect, within each group, all that `find` links.

    `members` has group, class, n and payload; `find(n, payloads, forest)` gives
    linking pairs of places. A group of more than `most_tokens` is searched in
    blocks that all hold its least class; the classes that aren't connected to
    it are then searched against every block.
    """
    members = cut(members)
    sizes = members.groupBy("group").agg(F.sum("n").alias("tokens"), F.min("class").alias("hub"))
    blocked = sizes.withColumn("blocks", F.ceil(F.col("tokens") / most_tokens).cast("int")).where("blocks > 1").select(F.col("group").alias("g"), "hub", "blocks")
    several = cut(blocked)
    large = not several.isEmpty()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: pa.Table) -> pa.RecordBatch:
            names, n = rows.column("class").to_numpy(), rows.column("n").to_numpy()
            forest, hub = Forest(len(names)), rows.column("hub").to_pylist()
            known = np.flatnonzero(rows.column("known").to_numpy(zero_copy_only=False)).tolist()
            for i in known[1:]:
                forest.union(known[0], i)
            found = find(n, rows.column("payload").to_pylist(), forest)
            edges = [(0, int(names[i]), int(names[j])) for i, j in found]
            if hub[0] is not None:  # a block: who isn't connected to the hub
                root = forest.find(int(np.flatnonzero(names == hub[0])[0]))
                group = rows.column("group")[0].as_py()
                edges += [(1, group, int(names[i])) for i in range(len(names)) if forest.find(i) != root]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*edges, strict=True)) or [[], [], []], (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["kind", "a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = np.stack([table.column(c).to_numpy() for c in ("group", "block", "part")])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                if b - a > 1:
                    yield judged(table.slice(a, b - a))
            held = table.slice(int(ends[-1]) if len(ends) else 0).combine_chunks().to_batches()
        if held and sum(b.num_rows for b in held) > 1:
            yield judged(pa.Table.from_batches(held))

    def searched(rows: DataFrame) -> DataFrame:
        ordered = rows.select("group", "block", "part", "class", "n", "known", "hub", "payload").repartition("group", "block", "part").sortWithinPartitions("group", "block", "part", "class")
        return ordered.mapInArrow(search, "kind int, a long, b long")

    plain = {"part": F.lit(0), "known": F.lit(False)}
    whole = members.withColumns(plain | {"block": F.lit(0), "hub": F.lit(None).cast("long")})
    if not large:
        return searched(whole).where("kind = 0").select("a", "b")
    whole = whole.join(several, F.col("group") == F.col("g"), "left_anti")
    block_of = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    inside = members.join(several, F.col("group") == F.col("g")).withColumn("own", block_of)
    everywhere = F.when(F.col("class") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = cut(searched(whole.unionByName(inside.withColumn("block", F.explode(everywhere)).withColumns(plain).select(whole.columns))))
    edges = first.where("kind = 0").select("a", "b")
    lone = first.where("kind = 1").select(F.col("a").alias("lone_group"), F.col("b").alias("lone_class")).distinct()
    # lone classes, dealt to parts of bounded size, against every block of their group
    weight = inside.join(lone, (F.col("group") == F.col("lone_group")) & (F.col("class") == F.col("lone_class"))).drop("lone_group", "lone_class")
    parts = weight.groupBy(F.col("group").alias("p")).agg(F.ceil(F.sum("n") / most_tokens).cast("int").alias("parts"))
    asked = weight.join(parts, F.col("group") == F.col("p")).withColumn("part", F.pmod(F.xxhash64("class", F.lit(1)), F.col("parts")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    known = lone.withColumn("is_lone", F.lit(True))
    against = inside.join(parts, F.col("group") == F.col("p")).join(known, (F.col("group") == F.col("lone_group")) & (F.col("class") == F.col("lone_class")), "left")
    against = against.withColumn("block", F.col("own")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["group", "block", "part", "class", "n", "payload"]
    second = asked.select(*columns, F.lit(False).alias("known")).unionByName(against.select(*columns, F.col("is_lone").isNull().alias("known")))
    second = second.withColumn("hub", F.lit(None).cast("long")).dropDuplicates(["group", "block", "part", "class"])
    return cut(edges.unionByName(searched(second).where("kind = 0").select("a", "b")))


def confirmed_links(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that connect all classes that are linked."""
    pairs = grouped(docs, hot_tokens(docs))
    bitmaps = pairs.join(signatures(docs), "class")
    clusters = components(link_groups(bitmaps, _bitmap_links, GROUP_TOKENS))
    if _repeats(docs):
        # ids don't tell which row holds a class: each task gives one text of each of its classes
        wanted = clusters.select(F.col("root").alias("group"), F.col("node").alias("wanted"))
        texts = _texts_of_classes(docs).join(wanted, F.col("class") == F.col("wanted")).select("group", "class", "n", "payload").dropDuplicates(["group", "class"])
    else:
        least = named.groupBy("class", "n").agg(F.min(F.col("doc_id").cast("long")).alias("owner"))
        wanted = clusters.join(least, F.col("node") == F.col("class")).select(F.col("root").alias("group"), "class", "n", "owner")
        held = docs.select(F.col("doc_id").cast("long").alias("text_owner"), F.col("text").cast("binary").alias("payload"))
        texts = held.join(wanted, F.col("text_owner") == F.col("owner")).select("group", "class", "n", "payload")
    return link_groups(texts, _text_links, CLUSTER_TOKENS)


def _texts_of_classes(docs: DataFrame) -> DataFrame:
    """(class, n, payload): the text of each class; a class may come from several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, buf, offsets in pieces(batches):
            sets = shingle_sets(buf, offsets)
            fresh = pa.array(_fresh(sets, seen))
            texts = part.column("text").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(sets.name), pa.array(sets.sizes), texts], ["class", "n", "payload"]).filter(fresh)

    return docs.select("text").mapInArrow(run, "class long, n long, payload binary")


def _repeats(docs: DataFrame) -> bool:
    """Whether ids don't tell the rows of `docs` apart."""
    return not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def _judged(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (row, doc_id, text): row, doc_id, class, what `assess` gives, and root, null for an empty set."""
    named = cut(classes_of(docs))
    owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LARGEST))
    least = named.where("n > 0").groupBy("class").agg(F.min(owner).alias("owner"))
    roots = components(confirmed_links(docs, named.where("n > 0")))
    least = least.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    smallest = least.groupBy(F.col("root").alias("r")).agg(F.min("owner").alias("component_id"))
    component = least.join(smallest, F.col("root") == F.col("r")).select(F.col("class").alias("c"), "root", "component_id")
    out = named.join(component, (F.col("class") == F.col("c")) & (F.col("n") > 0), "left")
    own = F.when(F.col("n") > 0, F.nullif("component_id", F.lit(_LARGEST))).otherwise(F.col("doc_id").cast("long"))
    return out.select("row", "doc_id", "class", "root", F.col("n").alias("n_shingles"), own.alias("component_id"))


def assess(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return _judged(docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are the smallest of their component, one of each, and those linked with nothing.

    The smallest has the smallest id, null last. Where ids repeat or are null,
    ties go to the least class, then the least key of the row; of equal rows one stays.
    """
    rows = sheltered(docs)
    if _repeats(rows):
        keyed = rows.withColumn("key", row_key(*rows.columns))
        judged = _judged(keyed.select(F.col("key").alias("row"), "doc_id", "text"))
        rank = F.struct(F.col("doc_id").isNull(), "doc_id", "class", "row")
        # an empty set is a component of its own row
        survivor = judged.groupBy(F.col("root").isNull(), F.coalesce("root", "row")).agg(F.min(rank).alias("least"))
        stays = cut(survivor.select(F.col("least.row").alias("stays")))
        kept = keyed.join(stays, F.col("key") == F.col("stays"), "left_semi").dropDuplicates(["key"]).drop("key")
    else:
        gone = cut(assess(rows).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")))
        # few ids go to the texts; many and the texts are shuffled
        kept = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col("doc_id") == F.col("gone"), "left_anti")
    return kept.toDF(*docs.columns)
