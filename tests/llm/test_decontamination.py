import hashlib
import random

from rillstone.llm import decontamination as D
from tests.llm import brute


def corpus(seed=5):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(8)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([0, 1, 2, 5, 9, 10, 14, 30])))) for i in range(12)]
    rows = []
    for d in range(60):
        w = words(rng.randrange(0, 40))
        if d % 3 == 0:
            item = brute.plain(items[rng.randrange(12)][1])
            w[5:5] = item[: rng.randrange(1, 31)]
        rows.append((d, rng.choice([" ", ", ", "-", "\n"]).join(w).upper()))
    return rows, items


def check(spark, documents, rows, items, **options):
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = D.search(documents(*rows).select("doc_id", "text"), frame, **options)
    assert found.count() == len(rows)
    out = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["items_sha256"], r["contaminated"]) for r in D.assess(documents(*rows), frame).collect())
    wanted = [(str(d), n, hit, names, hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0) for (d, _), (n, hit, names) in zip(rows, brute.decontaminate(rows, items), strict=True)]
    assert out == sorted(wanted)


def test_like_brute_force(spark, documents):
    rows, items = corpus()
    check(spark, documents, rows, items)


def test_blocks_of_items_change_nothing(spark, documents, monkeypatch):
    rows, items = corpus(6)
    monkeypatch.setattr(D.search, "__defaults__", (D.WINDOW, 20))
    check(spark, documents, rows, items)


def test_nulls_repeats_and_no_items(spark, documents):
    text = " ".join(f"w{i}" for i in range(12))
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, "short one")]
    items = [(7, text), (7, text), (8, None), (9, ""), (10, "Short: ONE!")]
    check(spark, documents, rows, items)
    check(spark, documents, rows, [])


def test_clean_keeps_rows_and_columns(spark, documents):
    text = " ".join(f"w{i}" for i in range(12))
    frame = documents((1, f"before {text} after"), (2, "nothing here"), (3, None)).withColumnRenamed("lang", "items")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    out = D.clean(frame, items)
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3] and out.columns == frame.columns
    assert D.clean(documents(), items).count() == 0


def test_shifts_skip_places():
    import numpy as np
    import pyarrow as pa

    from rillstone.llm.words import PLAIN, buffers, scan

    (finder,) = D.searchers([("a", b"one two three four five six seven eight nine ten")])
    words = scan(*buffers(pa.array(["x " * 9 + "one two three four five six seven eight nine ten y"])), PLAIN, lower=True)
    assert [(b, i) for _, b, i in finder.search(words, words.hashes())] == [(9, {"a"})]
    assert finder.shift.max() == 9 and int((finder.shift == 0).sum()) == 1 and np.all(finder.shift <= 9)


def test_passes_end_before_the_next_begins(spark, documents, monkeypatch):
    passes = []
    real = D.cut
    monkeypatch.setattr(D, "cut", lambda df: passes.append(df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")) or real(df))
    rows = [(d, f"say w{d}a w{d}b w{d}c") for d in range(6)]
    items = spark.createDataFrame([(d, f"w{d}a w{d}b w{d}c") for d in range(6)], "item_id long, text string")
    out = D.search(documents(*rows).select("doc_id", "text"), items, block_words=4)
    assert {r["doc_id"]: r["__items"] for r in out.collect()} == {d: [str(d)] for d in range(6)}
    assert len(passes) >= 2 and set(passes) == {1} and out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_columns_of_any_name_are_carried(spark, documents):
    extra = ["hits", "ITEMS", "Words", "__hits", "__items", "_hits", "a.b"]
    frame = brute.with_extra_columns(documents((1, "some text"), (2, None)), extra)
    out = D.clean(frame, spark.createDataFrame([(1, "other words")], "item_id long, text string"))
    assert out.columns == frame.columns
    assert sorted(brute.extra_cells(r, extra) for r in out.collect()) == [(d, *(f"{c}/{d}" for c in extra)) for d in (1, 2)]


def test_a_text_of_megabytes(spark, documents):
    words = " ".join(f"w{i % 5000}" for i in range(700_000))
    item = " ".join(f"x{i}" for i in range(10))
    out = D.assess(documents((1, f"{words} {item} {words}")), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()[0]
    assert (out["n_words"], out["n_hit"], out["n_items"]) == (1_400_010, 10, 1)
