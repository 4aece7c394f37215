import pytest

from rillstone.plans.syntax import Source
from rillstone.program import Program
from rillstone.sources.facts import parse_sizes, read_relation


def read(spark, tmp_path, text, types, **options):
    path = tmp_path / "r.csv"
    path.write_text(text)
    source = Source("r.csv", options.pop("delimiter", ","), options.pop("header", False))
    return sorted(map(tuple, read_relation(spark, str(path), types, source, **options).collect()))


def test_blank_lines_empty_fields_quotes_and_trailing_space(spark, tmp_path):
    assert read(spark, tmp_path, '1,a  \n\n2,\n3, "b" \n', ["int", "string"]) == [(1, "a"), (2, ""), (3, ' "b"')]
    assert read(spark, tmp_path, "1,a  \n", ["int", "string"], strip=False) == [(1, "a  ")]


def test_delimiters_are_text_and_headers_are_skipped(spark, tmp_path):
    assert read(spark, tmp_path, "id|w\n1|x.y\n2|\n", ["bigint", "string"], delimiter="|", header=True) == [(1, "x.y"), (2, "")]
    assert read(spark, tmp_path, "1\ta b\n", ["bigint", "string"], delimiter="\t") == [(1, "a b")]


@pytest.mark.parametrize("line", ["1", "1,2,3", "1,x", "99999999999,2"])
def test_wrong_lines_are_errors_on_collect_and_on_count(spark, tmp_path, line):
    path = tmp_path / "r.csv"
    path.write_text(f"1,2\n{line}\n")
    frame = read_relation(spark, str(path), ["int", "int"], Source("r.csv", ","))
    for act in (frame.collect, frame.distinct().count):
        with pytest.raises(Exception):  # noqa: B017
            act()


def test_wide_lines_pass_where_not_strict(spark, tmp_path):
    assert read(spark, tmp_path, "1,2,3\n", ["int", "int"], strict=False) == [(1, 2)]


def test_missing_files(spark, tmp_path):
    with pytest.warns(UserWarning, match="taken as empty"):
        assert read_relation(spark, str(tmp_path / "none.csv"), ["int"], Source()).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_relation(spark, str(tmp_path / "none.csv"), ["int"], Source(), missing="error")


def test_program_over_files(spark, tmp_path, capsys):
    (tmp_path / "Arc.csv").write_text("1,2\n2,3\n2,3\n")
    text = """.decl Arc(x: int32, y: int32)
    .input Arc(IO="file", filename="Arc.csv", delimiter=",")
    .decl Tc(x: int32, y: int32)
    Tc(x, y) :- Arc(x, y). Tc(x, z) :- Tc(x, y), Arc(y, z).
    .printsize Arc
    .printsize Tc
    .output Tc(delimiter="|")"""
    result = Program.parse(text).run(spark, facts_dir=str(tmp_path))
    assert parse_sizes("\n".join(result.size_lines())) == {"arc": 2, "tc": 3}
    result.write(str(tmp_path / "out"))
    assert sorted(spark.read.text(str(tmp_path / "out/Tc.csv")).toPandas().value) == ["1|2", "1|3", "2|3"]
    result.write("-")
    assert sorted(capsys.readouterr().out.split()) == ["1|2", "1|3", "2|3"]


def test_inputs_without_facts(spark):
    program = Program.parse(".decl A(x: int32)\n.input A\n.printsize A")
    assert program.run(spark).sizes() == {"A": 0}
    with pytest.raises(ValueError, match="no facts for A"):
        program.run(spark, missing="error")
    with pytest.raises(ValueError, match="not declared"):
        program.run(spark, {"B": spark.range(1)})
    with pytest.raises(ValueError, match="columns"):
        program.run(spark, {"A": spark.range(1).selectExpr("id", "id as b")})


def test_headers_of_files_that_split(spark, tmp_path):
    folder = tmp_path / "r.csv"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.csv").write_text("id,w\n" + "".join(f"{k * 1000 + i},\"w{i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        frame = read_relation(spark, str(folder), ["bigint", "string"], Source("r.csv", ",", True))
        assert frame.rdd.getNumPartitions() > 4
        assert sorted(map(tuple, frame.collect())) == sorted((k * 1000 + i, f'"w{i}') for k in range(2) for i in range(500))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_commands_round_trip(spark, tmp_path):
    from rillstone.sources.commands import read_commands, run_commands, write_commands

    names = [(1, 'a "b", (c)'), (2, "back\\slash"), (3, "")]
    path = str(tmp_path / "c")
    write_commands({"Name": spark.createDataFrame(names, "k long, w string"), "Arc": spark.createDataFrame([(1, 2)], "x long, y long")}, path)
    facts, dump = read_commands(spark, path, {"Name": ["bigint", "string"], "Arc": ["bigint", "bigint"]})
    assert dump and sorted(map(tuple, facts["Name"].collect())) == names and facts["Arc"].collect() == [(1, 2)]
    result = Program.parse(".decl Arc(x: int64, y: int64)\n.input Arc\n.decl T(x: int64)\nT(y) :- Arc(_, y).").run(spark, {"Arc": spark.createDataFrame([(5, 6)], "x long, y long")})
    (tmp_path / "one").write_text("start;\ninsert Arc(7, 8);\ninsert Arc(5, 6);\ntimestamp;\ncommit;\ndump RelationSizes;\n")
    assert run_commands(result, str(tmp_path / "one")) == ["[size][Arc] t=() size=2", "[size][T] t=() size=2"]


@pytest.mark.parametrize("text", ["start;\ninsert Arc(1, 2);\n", "commit;\nremove Arc(1, 2);\n", "commit;\ninsert Other(1);\n", "commit;\ninsert Arc(1);\n", "commit;\ninsert Arc(1, x);\n", "commit;\ncommit;\n"])
def test_wrong_commands_are_errors(spark, tmp_path, text):
    from rillstone.sources.commands import read_commands

    (tmp_path / "c").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        read_commands(spark, str(tmp_path / "c"), {"Arc": ["bigint", "bigint"]})[0]["Arc"].collect()


def test_declared_columns(spark, tmp_path):
    from rillstone.sources.facts import scan

    (tmp_path / "p.txt").write_text("Person.id|name\n1|x\n2|y\n")
    frame = scan(spark, str(tmp_path / "p.txt"), {"Person.id": "bigint", "name": "string"})
    assert frame.dtypes == [("Person.id", "bigint"), ("name", "string")] and sorted(map(tuple, frame.collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "q.txt").write_text("Person.id|name\none|x\n")
    with pytest.raises(Exception, match="MALFORMED"):
        scan(spark, str(tmp_path / "q.txt"), {"Person.id": "bigint", "name": "string"}).collect()


def test_folders_are_removed(spark):
    from pathlib import Path

    from rillstone import runtime

    paths = [runtime.work_folder(spark, "facts") for _ in range(2)]
    for path in paths:
        spark.range(3).write.parquet(path)
    local = [Path(p.removeprefix("file:")) for p in paths]
    assert all(p.exists() for p in local)
    runtime.remove(spark, paths[0])
    assert not local[0].exists() and local[1].exists()
    with pytest.raises(ValueError, match="wasn't made here"):
        runtime.remove(spark, "/tmp")
    assert runtime.cleanup(spark) >= 1 and not local[1].exists()


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from rillstone import runtime

    none = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: none), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf={}))
