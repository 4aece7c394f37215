import random

import numpy as np
import pytest

from rillstone.llm import ngram_join as J
from rillstone.llm.components import components
from rillstone.llm.signature_tree import Forest, fold, links, signature
from tests.llm import brute


def corpus(seed=4, n=70):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        if rows and rng.random() < 0.6:
            w = brute.spaced(rng.choice(rows[: max(1, len(rows) // 3)])[1])
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        else:
            w = [f"w{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 3, 5, 12, 40, 90]))]
        rows.append((d, " ".join(w)))
    return rows


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


@pytest.mark.parametrize(("hot", "group", "cluster"), [(64, 1 << 22, 1 << 20), (1, 300, 200)])
def test_like_brute_force(spark, documents, monkeypatch, hot, group, cluster):
    monkeypatch.setattr(J, "GROUP_TOKENS", group)
    monkeypatch.setattr(J, "CLUSTER_TOKENS", cluster)
    monkeypatch.setattr(J.hot_tokens, "__defaults__", (hot,))
    rows = corpus()
    assert got(J.assess(documents(*rows).repartition(3))) == brute.jaccard_components(rows)


def test_threshold_is_exact(spark, documents):
    base = [f"w{i}" for i in range(14)]  # ten shingles
    near = [*base[:-1], "x"]  # nine of eleven: 0.818
    far = ["y", *base[1:-1], "z"]  # eight of twelve
    exact = [*base[:12]]  # eight of ten: 0.8
    rows = [(1, " ".join(base)), (2, " ".join(near).upper()), (3, " ".join(far)), (4, " ".join(exact))]
    assert got(J.assess(documents(*rows))) == brute.jaccard_components(rows) == {1: (10, 1), 2: (10, 1), 3: (10, 3), 4: (8, 1)}


def test_nulls_repeats_and_short_texts(spark, documents):
    rows = [(5, "a b"), (4, "A  b"), (3, None), (2, ""), (9, "a b"), (9, "a b"), (None, "a b"), (None, "q"), (8, "b a")]
    out = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in J.assess(documents(*rows)).collect())
    assert out == sorted([("5", 1, "4"), ("4", 1, "4"), ("3", 0, "3"), ("2", 0, "2"), ("9", 1, "4"), ("9", 1, "4"), ("None", 1, "4"), ("None", 1, "None"), ("8", 1, "8")])


def test_one_id_with_two_texts(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "something else entirely here now"), (1, text), (2, text + " more")]
    out = sorted((r["doc_id"], r["component_id"]) for r in J.assess(documents(*rows)).collect())
    assert out == [(1, 1), (1, 1), (2, 1)]


def test_empty_table(spark, documents):
    assert J.assess(documents()).count() == 0 and J.keep_one(documents()).count() == 0


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_keep_one_keeps_columns(spark, documents, monkeypatch, most):
    monkeypatch.setattr(J, "BROADCAST_IDS", most)
    text = " ".join(f"w{i}" for i in range(30))
    frame = documents((3, text), (1, text), (2, text + " more"), (4, "alone"), (5, None)).withColumnRenamed("lang", "class")
    out = J.keep_one(frame)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 5] and out.columns == frame.columns


def test_trees_confirm_every_pair_that_could_link():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 200)).astype(np.uint64)) for _ in range(12)]
    sets = base + [np.unique(np.append(b[rng.random(len(b)) < 0.93], rng.integers(0, 1 << 63, 1 + len(b) // 30).astype(np.uint64))) for b in base for _ in range(4)]
    sizes = np.array([len(s) for s in sets])

    def linked(x, y):
        both = len(np.intersect1d(sets[x], sets[y]))
        return 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both)

    forest, plain = Forest(len(sets)), Forest(len(sets))
    found = links(sizes, [signature(s) for s in sets], linked, forest)
    for x in range(len(sets)):
        for y in range(x):
            if linked(x, y):
                plain.union(x, y)
    group = lambda f: sorted(sorted(i for i in range(len(sets)) if f.find(i) == r) for r in {f.find(i) for i in range(len(sets))})
    assert group(forest) == group(plain) and all(linked(x, y) for x, y in found)


def test_folded_signatures_are_of_the_same_set():
    tokens = np.arange(1000, 1100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.zeros(128, bool)
    bits[(tokens & np.uint64(127)).astype(int)] = True
    assert np.array_equal(np.unpackbits(fold(signature(tokens), 2).view(np.uint8), bitorder="little").astype(bool), bits)


@pytest.mark.parametrize("hot", [5, 100_000])
def test_components_of_a_path_and_a_star(spark, monkeypatch, hot):
    monkeypatch.setattr("rillstone.llm.components.HOT", hot)
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_tells_rows_of_null_and_repeated_ids_apart(spark, documents):
    own = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcdefg"}
    near = own["a"] + " more"
    rows = [(None, own["b"]), (None, own["c"]), (None, near), (1, own["a"]), (7, own["d"]), (7, own["e"]), (7, near)]
    rows += [(None, own["f"]), (None, own["f"] + " more"), (9, own["g"]), (9, own["g"]), (None, None), (None, ""), (3, "")]
    out = [(r["doc_id"], r["text"]) for r in J.keep_one(documents(*rows).repartition(3)).collect()]
    of_f = [t for _, t in out if t and t.startswith("f0")]
    assert len(of_f) == 1
    wanted = [(None, own["b"]), (None, own["c"]), (1, own["a"]), (7, own["d"]), (7, own["e"]), (None, of_f[0]), (9, own["g"]), (None, None), (None, ""), (3, "")]
    assert sorted(map(str, out)) == sorted(map(str, wanted))


def test_keep_one_carries_columns_of_any_name(spark, documents):
    text = " ".join(f"w{i}" for i in range(30))
    extra = ["KEY", "other", "row", "class", "root", "component_id", "__gone", "__key", "a.b"]
    for rows in ([(3, text), (1, text), (4, "alone")], [(3, text), (1, text), (4, "alone"), (4, "lone too"), (None, text)]):
        frame = brute.with_extra_columns(documents(*rows), extra)
        out = J.keep_one(frame)
        got_rows = [brute.extra_cells(r, extra) for r in out.collect()]
        assert out.columns == frame.columns and sorted(d for d, *_ in got_rows) == [1, *[4] * (len(rows) - 2 - (len(rows) > 3))]
        assert got_rows == [(d, *(f"{c}/{d}" for c in extra)) for d, *_ in got_rows]


def test_values_met_once_are_sampled():
    values = np.arange(160_000, dtype=np.uint64)
    counts, stays = J.sample_once(values, np.ones(len(values), np.int64), 3)
    assert abs(counts[stays].sum() / len(values) - 1) < 0.05
    assert not np.array_equal(stays, J.sample_once(values, np.ones(len(values), np.int64), 4)[1])
    assert J.sample_once(values[:3], np.array([2, 5, 1]), 0)[0].tolist() == [2, 5, 16]
