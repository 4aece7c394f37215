import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tests.conftest import ROOT
from tests.llm import brute

import corpus_pipeline


def corpus():
    rng = random.Random(9)
    text = lambda n: "\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(20)) for _ in range(n))
    bench = " ".join(f"bench{i}" for i in range(30))
    shared = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, text(5)) for i in range(20)]
    rows += [(30, rows[3][1]), (31, rows[4][1].replace(rows[4][1].split()[7], "edited"))]  # an exact and a near copy
    rows += [(40, text(4) + "\n" + shared), (41, text(4) + "\n" + shared + "\n" + text(1))]
    rows += [(50, text(4) + " " + bench.upper() + " " + text(2)), (60, "too short"), (61, "again and again " * 60), (70, None)]
    return rows, [(1, bench)]


def test_stages_take_effect(spark, documents, tmp_path):
    rows, items = corpus()
    frame = documents(*rows)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = frame, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else docs.collect())
        if k < 4:
            assert docs.columns == frame.columns
    good = {d for d, t in rows if not brute.quality(t)[5]}
    assert set(seen[0]) == good and not good & {60, 61, 70}
    components = brute.jaccard_components([(d, t) for d, t in rows if d in good])
    assert set(seen[1]) == {d for d, (_, c) in components.items() if c == d} and not set(seen[1]) & {30, 31}
    expected = {d: x for (d, _), x in zip(sorted(seen[1].items()), brute.substring_dedup(sorted(seen[1].items())), strict=True)}
    assert {d: " ".join(brute.spaced(t)) for d, t in seen[2].items()} == {d: x[2] for d, x in expected.items()} and expected[41][1] == 60
    assert set(seen[3]) == set(seen[2]) - {50}
    assert {r["doc_id"] for r in seen[4]} == set(seen[3]) and "sequence_id" in docs.columns
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r["doc_id"], r["piece"])
    assert [(*key(r), r["start"], r["length"], r["ids_crc32"]) for r in sorted(whole.collect(), key=key)] == [(*key(r), r["start"], r["length"], r["ids_crc32"]) for r in sorted(seen[4], key=key)]


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_the_rest_works_without_this_subpackage(tmp_path, pipeline_too):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    shutil.rmtree(copy / "rillstone" / "llm")
    shutil.rmtree(copy / "tests" / "llm")
    if pipeline_too:
        (copy / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tc' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q), q; assert e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, timeout=120).returncode == 0


def test_an_error_inside_the_subpackage_is_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    (copy / "rillstone" / "llm" / "words.py").write_text("import a_wheel_that_is_missing\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env=env, timeout=120, capture_output=True, text=True)
    assert run.returncode != 0 and "a_wheel_that_is_missing" in run.stderr


def test_nothing_else_imports_the_subpackage():
    for path in Path(ROOT).rglob("*.py"):
        inside = path.relative_to(ROOT).parts
        if "llm" not in inside and path.name not in ("corpus_pipeline.py", "__spark_entry__.py"):
            assert "rillstone.llm" not in path.read_text(), path


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
