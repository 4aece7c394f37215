import time

import pytest

from rillstone.harness import measure, runs, sweep, verdicts
from rillstone.plans.syntax import parse
from rillstone.plans.variants import apply, plans, text_of, variants, write_variants

TRIANGLE = """.decl A(x: int64, y: int64)
.decl T(x: int64, z: int64)
T(x, z) :- A(x, y), A(y, z), A(z, x), x != z.
.printsize T
"""


def test_plans_keep_connected_and_pair_unordered():
    (rule,) = parse(TRIANGLE).rules
    assert plans(rule) == [(0, 1, 2), (0, 2, 1), (1, 2, 0)]
    chain = parse(".decl A(x: int64, y: int64)\n.decl T(x: int64)\nT(a) :- A(a, b), A(b, c), A(c, d).").rules[0]
    assert plans(chain) == [(0, 1, 2), (1, 2, 0)]
    apart = parse(".decl A(x: int64, y: int64)\n.decl T(x: int64)\nT(a) :- A(a, b), A(c, d), A(d, e).").rules[0]
    assert plans(apart) == []


def test_small_space_is_whole_and_named():
    found = variants(parse(TRIANGLE))
    assert [(v.name, v.kind, v.signature) for v in found] == [
        ("default", "default", "r0=0,1,2"),
        ("ablation_r0_p01", "ablation", "r0=0,2,1"),
        ("ablation_r0_p02", "ablation", "r0=1,2,0"),
    ]
    two = variants(parse(TRIANGLE + "T(x, z) :- A(z, y), A(y, x), A(x, z)."))
    assert len(two) == 9 and sum(v.kind == "variant" for v in two) == 4


def test_large_space_is_sampled_with_a_bound_and_a_seed():
    text = ".decl A(x: int64, y: int64)\n.decl T(x: int64)\n" + "T(a) :- A(a, b), A(b, c), A(c, d), A(d, e), A(e, f), A(f, a).\n" * 3
    found = variants(parse(text))
    assert sum(v.kind == "sample" for v in found) == 100 and sum(v.kind == "ablation" for v in found) == 36
    assert [v.signature for v in found] == [v.signature for v in variants(parse(text))]
    assert len({v.orders for v in found}) == len(found)


def test_variants_are_written_with_a_manifest(tmp_path):
    (tmp_path / "mine.dl").write_text("kept")
    (tmp_path / "sample_0009.dl").write_text("old")
    write_variants(parse(TRIANGLE), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["ablation_r0_p01.dl", "ablation_r0_p02.dl", "manifest.csv", "mine.dl"]
    lines = (tmp_path / "manifest.csv").read_text().splitlines()
    assert lines[0] == "variant,kind,rule_perms,signature" and len(lines) == 4
    written = parse((tmp_path / "ablation_r0_p01.dl").read_text())
    assert str(written.rules[0]) == "T(x, z) :- A(x, y), A(z, x), A(y, z), x != z."


def test_strings_with_dots_survive_emission():
    tree = parse('.decl A(s: string)\n.decl B(s: string)\nB(a) :- A(a), A(a), A(a), a != "java.util.prefs, x. y".')
    again = parse(text_of(apply(tree, variants(tree)[-1])))
    assert len(again.rules) == 1 and again.rules[0].body[-1] == tree.rules[0].body[-1]


def test_sweep_and_summary(spark, tmp_path):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "x long, y long")
    outcomes = sweep.sweep(spark, TRIANGLE, {"A": arcs})
    assert [o.verdict for o in outcomes] == ["match"] * 3 and outcomes[0].sizes == {"T": 3}
    sweep.write_csv(outcomes, str(tmp_path / "t.csv"))
    summary = sweep.summarise(str(tmp_path / "t.csv"))
    assert summary.timed == 3 and summary.default is not None and summary.fastest[1] <= summary.median <= summary.slowest[1]
    assert sweep.report(str(tmp_path)).startswith("t: 3 plans timed, 0 beyond the limit")
    late = sweep.sweep(spark, TRIANGLE, {"A": arcs}, limit=0.0)
    assert {o.verdict for o in late} == {"TIMEOUT"}


def test_failed_variants_are_rows(spark, tmp_path):
    outcomes = sweep.sweep(spark, TRIANGLE, {"A": spark.range(1)})
    assert {o.verdict for o in outcomes} == {"FAIL: ValueError"}
    sweep.write_csv(outcomes, str(tmp_path / "f.csv"))
    assert sweep.summarise(str(tmp_path / "f.csv")) is None


def test_size_verdicts():
    assert verdicts.sizes_verdict({"Tc": 3}, {"tc": 3}) == "match(1)"
    assert verdicts.sizes_verdict({"Tc": 3, "b": 1}, {"tc": 3}) == "match(1)+aux(1)"
    assert verdicts.sizes_verdict({"Tc": 3}, {"tc": 4}) == "MISMATCH:tc=3vs4"
    assert verdicts.sizes_verdict({"Tc": 3, "z": 1}, {"tc": 3, "x": 1}) == "PARTIAL(1):theirs-only=x;ours-only=z"
    assert verdicts.sizes_verdict({"a": 1}, {"b": 1}) == "n/a"


def test_row_verdicts():
    same = verdicts.compare_rows([("a ", 1)], [("a", 1)])
    assert same.verdict == "OK" and same.shared == 1
    other = verdicts.compare_rows([(" a",)], [("a",)])
    assert other.verdict == "MISMATCH" and other.only_ours == {(" a",)}
    assert verdicts.parameter_verdict("timeout", "error", None) == "OURS_TIMEOUT"
    assert verdicts.parameter_verdict("ok", "error", None) == "THEIRS_ERROR"
    assert verdicts.parameter_verdict("ok", "ok", same) == "OK"
    assert [verdicts.pair_verdict(v) for v in (["OK", "OK"], ["OK", "MISMATCH"], ["MISMATCH"], [])] == ["OK", "PARTIAL", "FAIL", "FAIL"]


def test_gate():
    gate = verdicts.Gate()
    assert gate.compare({"a": (1.0, 100.0)}, {"a": (1.05, 110.0)})[0] == 0
    assert gate.compare({"a": (1.0, 100.0)}, {"a": (1.2, 100.0)})[0] == 1
    assert gate.compare({"a": (1.0, 100.0)}, {"a": (1.0, 121.0)})[0] == 1
    assert gate.compare({}, {})[0] == 2
    assert gate.compare({"a": (1.0, 100.0), "b": (1.0, 1.0)}, {"b": (9.0, 1.0)})[0] == 3


def test_measures():
    assert measure.seconds("executed in 12.5ms") == pytest.approx(0.0125)
    assert measure.seconds("3µs") == pytest.approx(3e-6) and measure.seconds("none") is None
    assert measure.last_seconds("Data loaded for a: 1s\nData loaded for b: 2.5s", "Data loaded") == 2.5
    assert measure.execution_seconds(1.0, 2.0) == 0.0 and measure.execution_seconds(None, 1) is None
    assert measure.ratio(1, 3) == "0.333333" and measure.ratio(1, 0) == "" and measure.mebibytes(1536) == "1.50" and measure.mebibytes(None) == "N/A"
    assert measure.median_int([3, 1, 2]) == 2 and measure.median_int([1, 4]) == 2 and measure.median_int([]) is None and measure.mean_int([1, 2]) == 1
    some = [measure.Run(s, 1) for s in (4.0, 1.0, 3.0, 2.0)]
    assert measure.median_run(some).seconds == 3.0
    assert len(measure.timed(lambda: 1, 2)) == 2


def test_pairs_and_identity(tmp_path):
    found = runs.parse_pairs("# all\ntc = G5K [one:skip] [two:skip] # slow\n\nbroken\nsg=x\n")
    assert found == [runs.Pair("tc", "G5K", frozenset({"one:skip", "two:skip"})), runs.Pair("sg", "x")]
    now = runs.identity("tc=G5K", workers=4)
    runs.guard(str(tmp_path / "r"), now)
    runs.guard(str(tmp_path / "r"), now)
    with pytest.raises(runs.IdentityChanged, match="workers: 4 before, 8 now"):
        runs.guard(str(tmp_path / "r"), runs.identity("tc=G5K", workers=8))
    runs.guard(str(tmp_path / "r"), runs.identity("tc=G5K", workers=8), fresh=True)


def test_datasets_are_never_deleted_through_links(tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    with pytest.raises(ValueError):
        runs.remove_dataset(str(tmp_path / "link"))
    runs.remove_dataset(str(tmp_path / "real"))
    assert not (tmp_path / "real").exists()


def test_parameters_are_checked_one_by_one(spark, tmp_path):
    from rillstone.harness.parameters import crosscheck, write_tsv
    from rillstone.program import Program

    program = Program.parse(".decl A(x: int64, y: int64)\n.decl Param(x: int64)\n.decl Out(y: int64)\nOut(y) :- Param(x), A(x, y).")
    arcs = [(1, 2), (1, 3), (2, 4)]

    def other(parameter):
        if parameter == (3,):
            raise RuntimeError
        return [(y,) for x, y in arcs if x == parameter[0]] + ([(99,)] if parameter == (2,) else [])

    verdict, lines = crosscheck(spark, program, {"A": spark.createDataFrame(arcs, "x long, y long")}, "Param", [(1,), (2,), (3,), (4,)], "Out", other)
    assert verdict == "PARTIAL" and [line.verdict for line in lines] == ["OK", "MISMATCH", "THEIRS_ERROR", "OK"]
    write_tsv(lines, str(tmp_path / "p.tsv"))
    rows = [line.split("\t") for line in (tmp_path / "p.tsv").read_text().splitlines()]
    assert [r[4:] for r in rows[1:]] == [["2", "2", "OK"], ["1", "2", "MISMATCH"], ["0", "0", "THEIRS_ERROR"], ["0", "0", "OK"]]


def test_sessions_keep_their_settings(spark):
    from rillstone.session import SETTINGS, session

    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        assert session().conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    finally:
        for k, v in before.items():
            if v is not None and spark.conf.isModifiable(k):
                spark.conf.set(k, v)


def test_charts_hold_every_value():
    import xml.etree.ElementTree as tree

    from rillstone.harness import charts

    rows = {"tc": {"ours": 1.0, "other": 10.0}, "sg": {"ours": 2.0, "other": 3.0}, "cc<": {"ours": 5.0, "other": None}}
    assert charts.slowdown_order(rows, "ours") == ["tc", "sg", "cc<"]
    svg = charts.bars(rows, "ours", "time & size")
    assert tree.fromstring(svg).tag.endswith("svg") and svg.count("<title>") == 5 and svg.count("×") == 1
    strip = charts.strip({"default": 1.0, "a": 0.5, "b": 2.0})
    assert tree.fromstring(strip) is not None and strip.count("<circle") == 3
    assert "nothing measured" in charts.bars({}, "ours", "t") and "nothing measured" in charts.strip({})


def test_peak_memory_is_of_the_engine_and_its_workers(spark):
    def hold(batches):
        held = b"x" * 400_000_000
        for batch in batches:
            time.sleep(0.3)
            yield batch
        del held

    quiet = measure.timed(lambda: spark.range(10).count(), 1, spark)[0].peak_kib
    loud = measure.timed(lambda: spark.range(0, 10, 1, 1).mapInArrow(hold, "id long").count(), 1, spark)[0].peak_kib
    assert loud > quiet + 300_000


def test_archives_unpack_inside_their_folder(tmp_path):
    import io
    import tarfile
    import zipfile

    import zstandard

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/Arc.csv", "1,2\n")
    assert runs.unpack(str(tmp_path / "a.zip"), str(tmp_path / "a")) == ["d/Arc.csv"] and (tmp_path / "a/d/Arc.csv").read_text() == "1,2\n"
    with pytest.raises(FileExistsError):
        runs.unpack(str(tmp_path / "a.zip"), str(tmp_path / "a"))

    def tar(name, link=False):
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w") as t:
            info = tarfile.TarInfo(name)
            if link:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                t.addfile(info)
            else:
                info.size = 4
                t.addfile(info, io.BytesIO(b"3,4\n"))
        return zstandard.compress(raw.getvalue())

    (tmp_path / "b.tar.zst").write_bytes(tar("Arc.csv"))
    assert runs.unpack(str(tmp_path / "b.tar.zst"), str(tmp_path / "b")) == ["Arc.csv"]
    for k, bad in enumerate((tar("../out.csv"), tar("link", link=True))):
        (tmp_path / f"bad{k}.tar.zst").write_bytes(bad)
        with pytest.raises(ValueError):
            runs.unpack(str(tmp_path / f"bad{k}.tar.zst"), str(tmp_path / f"bad{k}"))
        assert not (tmp_path / f"bad{k}").exists() and not (tmp_path / "out.csv").exists()


def test_lattices_agree_with_plain_rounds(spark, monkeypatch):
    from rillstone.harness.lattice import crosscheck
    from rillstone.operators import fixpoint
    from rillstone.program import Program

    text = """.decl Arc(x: int64, y: int64, w: int64)
    .decl Dist(x: int64, d: int64)
    .decl Far(x: int64)
    Dist(0, min(0)) :- Arc(_, _, _).
    Dist(y, min(d + w)) :- Dist(x, d), Arc(x, y, w).
    Far(x) :- Dist(x, d), d > 5."""
    arcs = spark.createDataFrame([(0, 1, 9), (0, 2, 1), (2, 1, 2), (1, 3, 4), (3, 0, 1), (5, 6, 1)], "x long, y long, w long")
    program = Program.parse(text)
    assert crosscheck(spark, program, {"Arc": arcs}, ["Dist", "Far"]) == {"Dist": "match(1)", "Far": "match(1)"}
    # one that improves nothing after its first round is told
    monkeypatch.setattr(fixpoint.Evaluator, "_round", lambda self, *a: {})
    assert crosscheck(spark, program, {"Arc": arcs}, ["Dist"]) == {"Dist": "MISMATCH"}
