import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import substring_dedup as S
from rillstone.llm.fm_index import FMIndex
from tests.llm import brute


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(10, 13), max_size=14), min_size=1, max_size=6), st.lists(st.integers(9, 15), max_size=12), st.integers(1, 6))
def test_index_gives_matching_statistics_and_least_owners(texts, query, threshold):
    owners = np.array([(7 * i + 3) % 11 for i in range(len(texts))])
    flat = lambda lists: np.array([x for t in lists for x in t], np.uint64)
    bounds = lambda lists: np.cumsum([0, *map(len, lists)])
    index = FMIndex(flat(texts), bounds(texts), owners, threshold)
    queries = [query, *texts]
    length, owner = index.matches(flat(queries), bounds(queries))
    at = 0
    for q in queries:
        for i in range(len(q)):
            held = lambda n: [o for t, o in zip(texts, owners, strict=True) if any(t[j : j + n] == q[i : i + n] for j in range(len(t) - n + 1))]  # noqa: B023, E731
            best = max((n for n in range(1, threshold + 1) if i + n <= len(q) and held(n)), default=0)
            assert length[at] == best
            assert owner[at] == (min(held(threshold)) if best == threshold else np.iinfo(np.int64).max)
            at += 1


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(400)}"
    passage = [word() for _ in range(60)]
    rows = []
    for d in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            a = rng.randrange(0, 45)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rng.randrange(5, 60)]
        if d % 7 == 0 and rows:
            w = brute.spaced(rows[-3][1] if len(rows) > 3 else rows[0][1])
            if w:
                w[len(w) // 3] = "edited"
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows


def got(frame):
    return sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect())


def wanted(rows):
    return sorted((d is None, d, *x) for (d, _), x in zip(rows, brute.substring_dedup(rows), strict=True))


@pytest.mark.parametrize("hot", [200, 1])
def test_like_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus()
    frame = documents(*rows).repartition(5)
    assert got(S.assess(frame)) == wanted(rows)


def test_small_indexes_and_merges_change_nothing(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "INDEX_WORDS", 30)
    monkeypatch.setattr(S, "MERGED", 3)
    rows = corpus(2)
    assert got(S.assess(documents(*rows))) == wanted(rows)


def test_nulls_repeats_and_short_texts(spark, documents):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (2, "a b c"), (3, None), (4, ""), (5, long), (5, long), (None, long + " x"), (7, long.replace("w15", "W15")), (7, "other text")]
    assert got(S.assess(documents(*rows))) == wanted(rows)


def test_empty_table(spark, documents):
    assert S.assess(documents()).count() == 0 and S.remove(documents()).count() == 0


def test_remove_keeps_columns_and_white_space(spark, documents):
    shared = " ".join(f"w{i}" for i in range(20))
    frame = documents((1, f"one\n{shared}  two"), (2, f"A  b\t{shared}\n\nend."), (3, shared), (4, "plain\n text"))
    frame = frame.withColumnRenamed("lang", "windows").withColumnRenamed("source", "row")
    out = {r["doc_id"]: r for r in S.remove(frame).collect()}
    assert sorted(out) == [1, 2, 4]
    assert out[1]["text"] == f"one\n{shared}  two" and out[2]["text"] == "A  b\tend." and out[4]["text"] == "plain\n text"
    assert out[2]["n_chars"] == len("A  b\tend.") and S.remove(frame).columns == frame.columns


@pytest.mark.parametrize("repeats", [False, True])
def test_columns_of_any_name_are_carried(spark, documents, repeats):
    shared = " ".join(f"w{i}" for i in range(20))
    extra = ["__row", "__FOUND", "__windows", "row", "windows", "key", "a.b"]
    rows = [(1, f"one {shared}"), (2, f"two {shared} end")] + [(2, "more"), (None, "none")] * repeats
    frame = brute.with_extra_columns(documents(*rows), extra)
    out = S.remove(frame)
    held = out.collect()
    assert out.columns == frame.columns and sorted(str(r["text"]) for r in held) == sorted([f"one {shared}", "two end", *["more", "none"] * repeats])
    assert [brute.extra_cells(r, extra) for r in held] == [(r["doc_id"], *(f"{c}/{'-' if r['doc_id'] is None else r['doc_id']}" for c in extra)) for r in held]


def test_a_text_of_megabytes(spark, documents):
    words = " ".join(f"w{i}" for i in range(300_000))
    out = got(S.assess(documents((1, words), (2, f"own {words}"))))
    assert out == wanted([(1, words), (2, f"own {words}")])


def test_an_index_is_smaller_than_its_text():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(1 << 47, 1 << 48, 60_000)).astype(np.uint64)
    share = 1 / np.arange(1, len(words) + 1)
    codes = rng.choice(words, 300_000, p=share / share.sum())
    bounds = np.append(np.arange(0, len(codes), 25), len(codes))
    index = FMIndex(codes, bounds, np.arange(len(bounds) - 1), S.WINDOW)
    held = sum(a.nbytes for a in vars(index).values() if isinstance(a, np.ndarray)) + index.groups.nbytes + index.wavelet.nbytes
    assert index.nbytes == held and held < 6 * len(codes), held / len(codes)
    length, owner = index.matches(codes[:2500], bounds[:101])
    assert np.array_equal(length, np.minimum(13, 25 - np.arange(2500) % 25)) and np.array_equal(owner[length == 13], np.repeat(np.arange(100), 13))


def test_codes_that_agree_in_their_upper_bits_are_told_apart():
    codes = np.array([5, 70_000, 65_536 + 1, 65_536 + 9, 65_536 * 3], np.uint64)
    index = FMIndex(codes, np.array([0, 5]), np.array([4]), 2)
    asked = np.array([5, 6, 65_536 + 1, 65_536 + 9, 65_536 + 10, 70_000, 65_536 * 3, 1 << 47], np.uint64)
    assert (index.symbols(asked) > 0).tolist() == [True, False, True, True, False, True, True, False]
    assert len(set(index.symbols(codes).tolist())) == 5 and index.matches(codes, np.array([0, 5]))[0].tolist() == [2, 2, 2, 2, 1]
