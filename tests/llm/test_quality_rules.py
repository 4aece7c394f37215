import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rillstone.llm import quality_rules as Q
from tests.llm import brute

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(frame, rows):
    out = sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in frame.collect())
    assert out == sorted((str(r[0]), *brute.quality(r[1])) for r in rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab c\n\t#|é\u00a0", max_size=60), min_size=1, max_size=30))
def test_figures_like_brute_force(spark, documents, texts):
    rows = list(enumerate(texts))
    check(Q.assess(documents(*rows)), rows)


def test_long_repeating_texts(spark, documents):
    rows = [(1, "a b c " * 400), (2, " ".join(f"w{i}" for i in range(3000))), (3, ("x y z " + " ".join(f"v{i}" for i in range(40)) + "\n") * 3), (4, "q q q q")]
    check(Q.assess(documents(*rows)), rows)


def test_nulls_repeats_and_empty_table(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None), (2, "", "s"), (3, text, None), (3, text, None), (None, text, "s")]
    check(Q.assess(documents(*rows)), rows)
    assert Q.assess(documents()).count() == 0
    kept = sorted(str(r["doc_id"]) for r in Q.filter_documents(documents(*rows)).collect())
    assert kept == ["3", "3", "None"]


def boiler(n, source="s"):
    """Documents of one line of their own and four of nine stock lines."""
    stock = [" ".join(f"stock{k}_{i}" for i in range(15)) for k in range(9)]
    choose = random.Random(1)
    return [(d, "\n".join([f"unique words of document number {d} come here", *choose.sample(stock, 4)]), source) for d in range(n)]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_documents_of_stock_lines_are_rejected(spark, documents, monkeypatch, most):
    monkeypatch.setattr(Q, "BROADCAST_ROWS", most)
    rows = [*boiler(40), (100, " ".join(f"w{i}" for i in range(70)), "s"), *[(200 + d, t, "other") for d, t, _ in boiler(2)]]
    out = {r["doc_id"]: r for r in Q.assess(documents(*rows), max_documents=5).collect()}
    assert not any(out[d]["kept"] for d in range(40)) and out[0]["n_line_words"] == 4 * 15
    assert out[100]["kept"] and out[200]["kept"] and out[200]["n_line_words"] == 0
    frame = documents(*rows).withColumnRenamed("lang", "row").withColumnRenamed("n_chars", "words")
    left = Q.filter_documents(frame, max_documents=5)
    assert sorted(r["doc_id"] for r in left.collect()) == [100, 200, 201] and left.columns == frame.columns


def test_copies_are_one_document(spark, documents):
    text = "\n".join(" ".join(f"w{k}_{i}" for i in range(12)) for k in range(8))
    edited = text.replace("w3_4", "changed")
    rows = [(d, text if d % 2 else edited, "s") for d in range(20)]
    assert all(r["kept"] and not r["n_line_words"] for r in Q.assess(documents(*rows), max_documents=5).collect())


@pytest.mark.parametrize("limit", [0, 200_000])
def test_joined_and_broadcast_lines_agree(spark, documents, monkeypatch, limit):
    monkeypatch.setattr(Q, "BROADCAST_LINES", limit)
    out = Q.assess(documents(*boiler(40)), max_documents=5)
    assert {r["n_line_words"] for r in out.collect()} == {60}


def test_main_path_is_native(spark, documents):
    plan = Q.assess(documents((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow"))


def test_documents_of_one_template_are_distinct(spark, documents):
    stock = "\n".join(" ".join(f"stock{k}_{i}" for i in range(15)) for k in range(9))
    rows = [(d, f"{stock}\neight words of document {d} that come here", "s") for d in range(100)]
    out = Q.assess(documents(*rows)).collect()
    assert {(r["n_line_words"], r["kept"]) for r in out} == {(135, False)}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_kept_documents_lose_lines_above_the_limit(spark, documents, monkeypatch, most):
    monkeypatch.setattr(Q, "BROADCAST_ROWS", most)
    own = {d: [" ".join(f"w{d}_{k}_{i}" for i in range(30)) for k in range(2)] for d in range(10)}
    rows = [(d, "\n".join([own[d][0], "All  Rights reserved", "", own[d][1], " all rights\tRESERVED"]), "s") for d in own]
    rows += [(20, rows[0][1], "other"), rows[3]]
    out = [(r["doc_id"], r["text"], r["n_chars"]) for r in Q.filter_documents(documents(*rows), max_documents=5).collect()]
    wanted = {d: "\n".join([own[d][0], "", own[d][1]]) for d in own} | {20: rows[0][1]}
    assert sorted(out) == sorted((d, wanted[d], len(wanted[d])) for d in [*wanted, 3])


def test_documents_of_samples_of_stock_lines_all_go(spark, documents):
    choose = random.Random(2)
    stock = [" ".join(f"stock{k}_{i}" for i in range(15)) for k in range(12)]
    rows = [(d, "\n".join(choose.sample(stock, 6)), "s") for d in range(400)]
    assert not any(r["kept"] for r in Q.assess(documents(*rows)).collect())
    assert Q.filter_documents(documents(*rows)).count() == 0


def test_a_document_left_with_too_few_words_goes(spark, documents):
    line = "this line stands in every one of these documents"
    rows = [(d, f"{line}\n" + " ".join(f"w{d}_{i}" for i in range(45 + d)), "s") for d in range(10)]
    out = {r["doc_id"]: (r["n_line_words"], r["base_failed"], r["kept"]) for r in Q.assess(documents(*rows), max_documents=5).collect()}
    assert out == {d: (9, False, d >= 5) for d in range(10)}


def test_the_limit_itself_is_not_above_it(spark, documents):
    rows = [(d, "one line of theirs\n" + " ".join(f"w{d}_{i}" for i in range(60)), "s") for d in range(5)]
    assert {r["n_line_words"] for r in Q.assess(documents(*rows), max_documents=5).collect()} == {0}
    assert {r["n_line_words"] for r in Q.assess(documents(*rows), max_documents=4).collect()} == {4}


def test_columns_of_any_name_are_carried(spark, documents):
    rows = [*boiler(12), (100, " ".join(f"w{i}" for i in range(70)), "s")]
    extra = ["key", "ROW", "ident", "Kept", "gone", "__row", "__key", "lines", "hash", "a.b", "w`x"]
    frame = brute.with_extra_columns(documents(*rows), extra)
    out = Q.filter_documents(frame, max_documents=5)
    assert out.columns == frame.columns
    kept = [brute.extra_cells(r, extra) for r in out.collect()]
    assert kept == [(d, *(f"{c}/{d}" for c in extra)) for d, *_ in kept] and 100 in [d for d, *_ in kept]
