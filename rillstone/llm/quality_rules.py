"""Quality rules: text statistics and lines that many documents of a host share.

Only DataFrame functions run on the main path. Statistics are per row, on
arrays. Lines are hashed after normalising (lower case, one space between
words), and a line is boilerplate where more than ``max_documents`` distinct
documents of its host (column ``source``) hold it. Documents that hold the same
set of lines are one document; documents that differ in any line, near copies
too, are distinct. Lines above the limit are removed (`filter_documents` returns
the text without them). A document is depleted, and rejected, when what it keeps
is fewer than ``min_words`` words, the least that the base rule asks of a whole
text, or less than ``min_share`` of its words, one put together from stock lines.

Edge cases: a null or empty text has no words, fails the base rule and isn't
kept. A null host is a host of its own, a null doc_id an id like any other.
Repeated rows each get the same result and count as one document. A line at the
limit isn't above it. An empty table gives an empty result. A text is held whole
in one row, with arrays of some ten times its size, so one of 50 MB needs a task
of about a GB. Columns beyond ``doc_id, text, source`` are ignored by `assess`
and carried by `filter_documents` whatever their names, but for ``n_chars``,
which follows a text that lost lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm.columns import sheltered
from rillstone.runtime import cut, row_key

SPACE = r"[\x20\x09-\x0D]+"
#: More distinct documents of one host than this make a line boilerplate.
MAX_DOCUMENTS = 50
#: A document is depleted when it keeps less than this share of its words ...
MIN_SHARE = 0.3
#: ... or fewer words than this, the base rule's least number.
MIN_WORDS = 50
#: Frequent lines of at most this number, 16 MB with their hosts, are broadcast; more are joined by shuffle.
BROADCAST_LINES = 200_000
#: Keys of rejected and changed rows, with the lines that these lose, of at most this number, 16 MB, are broadcast.
BROADCAST_ROWS = 1_000_000


def line_hash(line: Column) -> Column:
    """The first 60 bits of the line's MD5, as a number that other engines can tell too."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 15), 16, 10).cast("long")


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _has_words(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _neighbours(a: Column) -> Column:
    """Pairs of neighbours of an array with two or more elements."""
    n = F.size(a)
    return F.arrays_zip(F.slice(a, F.lit(1), n - 1).alias("a"), F.slice(a, F.lit(2), n - 1).alias("b"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, source, the base figures and `lines`: (hash, words) of each line that has words.

    One row per row of `docs`; `row` is equal for equal rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        "source",
        row_key("doc_id", "text", "source").alias("row"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("w"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.filter(F.split(text, "\n", -1), _has_words).alias("l"),
    )
    hashed = base.select(
        "doc_id", "source", "row", "n_symbols", "word_chars",
        F.size("w").cast("long").alias("n_words"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
        F.transform("l", _normalised).alias("l"),
    )
    n = F.size("h")
    pairs = F.zip_with("h", F.slice("h", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    threes = hashed.withColumns(
        {
            "t": F.when(n >= 3, F.slice(F.zip_with(pairs, F.slice("h", F.lit(3), F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")),
            "lines": F.transform("l", lambda x: F.struct(line_hash(x).alias("hash"), F.size(F.split(x, " ")).cast("long").alias("words"))),
        }
    ).drop("h", "l")
    # places of windows whose hash occurs twice or more, in order
    ordered = F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    ordered_threes = threes.withColumn("s", F.when((F.size("t") > 1) & (F.size(F.array_distinct("t")) < F.size("t")), ordered))
    twice = F.transform(F.filter(_neighbours(F.col("s")), lambda p: p["a"]["x"] == p["b"]["x"]), lambda p: F.array(p["a"]["i"], p["b"]["i"]))
    placed = ordered_threes.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(twice))))).drop("t", "s")
    # a window covers three words, or as many as come before the next window
    covered = F.aggregate(
        F.zip_with("p", F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return placed.withColumn("n_repeat_words", F.when(F.col("p").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("p")


def frequent_lines(stats: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(source, hash) of the lines that more than `max_documents` documents of a host share."""
    hashes = F.sort_array(F.array_distinct(F.col("lines.hash")))
    # copies are told by all their lines: a part of them may be stock lines that unlike documents share
    told = stats.select("source", hashes.alias("hashes")).select("source", F.xxhash64("hashes").alias("who"), F.explode("hashes").alias("hash"))
    return told.distinct().groupBy("source", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_documents).select("source", "hash")


def _judged(docs: DataFrame, max_documents: int, min_share: float, min_words: int) -> DataFrame:
    """Per row of `docs`: what `assess` gives, and `gone`, the hashes of removed lines, null where there are none."""
    # read anew for the lines and for the figures: Catalyst prunes each reading to what it needs
    stats = statistics(docs)
    frequent = cut(frequent_lines(stats, max_documents)).select(F.col("source").alias("f_source"), F.col("hash").alias("f_hash"))
    if frequent.count() <= BROADCAST_LINES:
        frequent = F.broadcast(frequent)
    held = stats.select("doc_id", "row", "source", F.posexplode("lines").alias("place", "line")).select("doc_id", "row", "source", "place", "line.hash", "line.words")
    held = held.join(frequent, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("hash") == F.col("f_hash")), "left_semi")
    # repeated rows hold the same places; a row's hash counts within its id, so no two documents are ever taken for one
    once = held.select("doc_id", "row", "place", "hash", "words").distinct()
    removed = once.groupBy("doc_id", "row").agg(F.sum("words").alias("words"), F.collect_set("hash").alias("gone")).withColumnsRenamed({"doc_id": "r_doc_id", "row": "r_row"})
    left = F.col("n_words") - F.col("n_line_words")
    return (
        stats.join(removed, (F.col("row") == F.col("r_row")) & F.col("doc_id").eqNullSafe(F.col("r_doc_id")), "left")
        .withColumn("n_line_words", F.coalesce("words", F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~((left < min_words) | (left < min_share * F.col("n_words"))))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed", "kept", "row", "gone")
    )


def assess(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of `docs`: doc_id, the base figures, n_line_words (words in removed lines), base_failed and kept."""
    return _judged(docs, max_documents, min_share, min_words).drop("gone")


def filter_documents(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` that `assess` keeps, without their lines above the limit, with the columns they came with."""
    rows = sheltered(docs)
    judged = _judged(rows, max_documents, min_share, min_words).where(~F.col("kept") | F.col("gone").isNotNull())
    # a rejected row needs no lines; repeated rows are judged alike
    told = judged.select(F.col("row").alias("told_row"), F.col("doc_id").alias("told_id"), "kept", F.when(F.col("kept"), F.col("gone")).alias("gone"))
    told = cut(told.dropDuplicates(["told_row", "told_id"]))
    size = told.agg(F.sum(1 + F.coalesce(F.array_size("gone"), F.lit(0)))).first()[0] or 0
    # few keys and lines go to the texts; many and the texts are shuffled
    told = F.broadcast(told) if size <= BROADCAST_ROWS else told
    same = (F.col("row") == F.col("told_row")) & F.col("doc_id").eqNullSafe(F.col("told_id"))
    joined = rows.withColumn("row", row_key("doc_id", "text", "source")).join(told, same, "left").where(F.coalesce("kept", F.lit(True)))
    stays = F.filter(F.split("text", "\n", -1), lambda x: ~(_has_words(x) & F.array_contains(F.col("gone"), line_hash(_normalised(x)))))
    changed = F.col("gone").isNotNull()
    out = joined.withColumn("text", F.when(changed, F.array_join(stays, "\n")).otherwise(F.col("text")))
    if "n_chars" in rows.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*rows.columns).toDF(*docs.columns)
