"""Runs a program of the library over a folder of tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.harness.lattice import crosscheck
from rillstone.library.facts import CHAIN
from rillstone.library.operators import NATION, OPERATORS
from rillstone.library.programs import PROGRAMS, Query
from rillstone.operators.search import shortest_lengths, shortest_paths
from rillstone.program import Program
from rillstone.runtime import table, work_folder
from rillstone.sources.commands import run_commands, write_commands
from rillstone.sources.facts import scan, write_relation

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def use_tables(spark: SparkSession, sf_dir: str) -> None:
    """Names the folder's star-schema tables for SQL; frames made from them keep what they were made from."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def run_query(spark: SparkSession, sf_dir: str, query: Query) -> DataFrame:
    use_tables(spark, sf_dir)
    result = Program.parse(query.text).run(spark, {name: spark.sql(text) for name, text in query.facts.items()})
    frames = [result.relation(name).toDF(*query.columns[: len(result.relation(name).columns)]) for name in query.outputs]
    if len(frames) == 1:
        return frames[0]
    wide = [
        frame.select(F.lit(name).alias("relation"), *(F.col(c) if c in frame.columns else F.lit(-1).cast("long").alias(c) for c in query.columns))
        for name, frame in zip(query.outputs, frames, strict=True)
    ]
    out = wide[0]
    for frame in wide[1:]:
        out = out.unionAll(frame)
    return out


def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as a delimited file, and read as a program's input, with its size beside each row."""
    use_tables(spark, sf_dir)
    folder = _folder(spark)
    write_relation(spark.sql(NATION), f"{folder}/nation.txt", "|")
    text = """.decl Nation(n: int32, name: string, r: int32)
    .input Nation(IO="file", filename="nation.txt", delimiter="|")
    .printsize Nation"""
    result = Program.parse(text).run(spark, facts_dir=folder)
    return result.relation("Nation").crossJoin(F.broadcast(result.size_frame().select("size")))


def sizes_of_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that the closure program prints."""
    use_tables(spark, sf_dir)
    query = PROGRAMS["tc"]
    return Program.parse(query.text).run(spark, {name: spark.sql(text) for name, text in query.facts.items()}).size_frame()


#: From each customer's first order to the last one, and to the last order of the table.
PAIRS = """select source, target from (select cast(min(struct(o_orderdate, o_orderkey)).o_orderkey as bigint) as source,
  cast(max(struct(o_orderdate, o_orderkey)).o_orderkey as bigint) as target from orders group by o_custkey) t"""


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps along each customer's chain of orders, stopped where the target is reached."""
    use_tables(spark, sf_dir)
    return shortest_lengths(spark.sql(CHAIN), spark.sql(PAIRS))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders on each customer's way from the first to the last one."""
    use_tables(spark, sf_dir)
    return shortest_paths(spark.sql(CHAIN), spark.sql(PAIRS)).select("source", "target", F.array_join("path", ">").alias("path"))


def _folder(spark: SparkSession) -> str:
    return work_folder(spark, "facts")


_NAMES = ".decl Nation(n: int32, name: string, r: int32)\n.input Nation(IO=\"file\", filename=\"nation.txt\", delimiter=\"|\"{options})"


def _read_lines(spark: SparkSession, lines: DataFrame, options: str = "") -> DataFrame:
    """Nations from a file of such lines."""
    folder = _folder(spark)
    lines.write.text(f"{folder}/nation.txt")
    return Program.parse(_NAMES.format(options=options)).run(spark, facts_dir=folder).relation("Nation")


def _lines(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    use_tables(spark, sf_dir)
    return spark.sql(f"select explode(array({form})) as value from (select cast(n_nationkey as string) as n, n_name as name, cast(n_regionkey as string) as r from nation) t")


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in files that each begin with a header."""
    use_tables(spark, sf_dir)
    folder = _folder(spark)
    spark.sql(NATION).repartition(3).write.csv(f"{folder}/nation.txt", sep="|", header=True)
    return Program.parse(_NAMES.format(options=', header="true"')).run(spark, facts_dir=folder).relation("Nation")


def missing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations beside an input whose file isn't there, which is empty."""
    use_tables(spark, sf_dir)
    folder = _folder(spark)
    write_relation(spark.sql(NATION), f"{folder}/nation.txt", "|")
    text = _NAMES.format(options="") + """
    .decl None(n: int32)
    .input None(IO="file", filename="none.txt", delimiter="|")
    .decl Left(n: int32, name: string, r: int32)
    Left(n, name, r) :- Nation(n, name, r), !None(n)."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return Program.parse(text).run(spark, facts_dir=folder).relation("Left").toDF("n", "name", "r")


def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with blank lines between them, which are passed over."""
    return _read_lines(spark, _lines(spark, sf_dir, "'', concat_ws('|', n, name, r), ''"))


def trailing_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose names have white space at their end, which goes."""
    return _read_lines(spark, _lines(spark, sf_dir, "concat_ws('|', n, concat(name, ' \\t'), r)"))


def refused_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which one line is wrong, and whether each is refused when it is read."""
    wrong = {"too few fields": "'1|x'", "too many fields": "'1|x|2|3'", "no integer": "'one|x|2'", "beyond its type": "'99999999999|x|2'", "none": "'1|x|2'"}
    told = []
    for what, line in wrong.items():
        good = _lines(spark, sf_dir, "concat_ws('|', n, name, r)")
        frame = _read_lines(spark, good.unionAll(spark.sql(f"select {line} as value")))
        try:
            frame.write.format("noop").mode("overwrite").save()
            told.append((what, False))
        except PySparkException:
            told.append((what, True))
    return spark.createDataFrame(told, "line string, refused boolean")


def written_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output relation's file, read as text."""
    use_tables(spark, sf_dir)
    folder = _folder(spark)
    text = """.decl Nation(n: int32, name: string, r: int32)
    .decl Region(r: int32, name: string)
    Region(r, cat(name, "!")) :- Nation(_, name, r).
    .output Region(delimiter="|")"""
    Program.parse(text).run(spark, {"Nation": spark.sql(NATION)}).write(folder)
    return spark.read.text(f"{folder}/Region.csv").withColumnRenamed("value", "line")


def command_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of a tree of customers, whose larger half arrives as a transaction of inserts."""
    use_tables(spark, sf_dir)
    folder, query = _folder(spark), PROGRAMS["tc"]
    arcs = spark.sql(query.facts["Arc"])
    write_commands({"Arc": arcs.where("y % 2 = 0")}, folder)
    result = Program.parse(query.text).run(spark, {"Arc": arcs.where("y % 2 = 1")})
    run_commands(result, folder)
    return result.relation("Tc")


def declared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a delimited file with a header and declared columns."""
    use_tables(spark, sf_dir)
    folder = _folder(spark)
    spark.sql(NATION).write.csv(f"{folder}/nation.txt", sep="|", header=True)
    scan(spark, f"{folder}/nation.txt", {"N.key": "bigint", "name": "string", "region": "int"}).createOrReplaceTempView("scanned_nation")
    return spark.sql("select region, count(*) as n, max(`N.key`) as largest from scanned_nation group by region order by region limit 3")


def lattice_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How recursive minima agree with an evaluation by whole rounds, and their sizes."""
    use_tables(spark, sf_dir)
    told = []
    for name, relation in (("cc", "Cc"), ("sssp", "Dist")):
        query = PROGRAMS[name]
        found = crosscheck(spark, Program.parse(query.text), {fact: spark.sql(text) for fact, text in query.facts.items()}, [relation])
        told.append((name, found[relation]))
    return spark.createDataFrame(told, "program string, verdict string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: (lambda spark, sf_dir, q=query: run_query(spark, sf_dir, q)) for name, query in (PROGRAMS | OPERATORS).items()}
    return found | {
        "s1_file_round_trip": file_round_trip,
        "s2_header": header_lines,
        "s4_missing_file": missing_file,
        "s5_blank_lines": blank_lines,
        "s6_s7_refused_lines": refused_lines,
        "s8_trailing_space": trailing_space,
        "s9_printsize": sizes_of_closure,
        "s10_output": written_output,
        "s12_command_stream": command_stream,
        "s14_declared_scan": declared_scan,
        "a4_lattice_check": lattice_check,
        "r9_early_stop": early_stop,
        "r9_path": paths,
    }


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, query in (PROGRAMS | OPERATORS).items() if (sql := query.sql())}
    found["s1_file_round_trip"] = "select n_nationkey as n, n_name as name, n_regionkey as r, cast((select count(*) from nation) as bigint) as size from nation"
    plain = "select n_nationkey as n, n_name as name, n_regionkey as r from nation"
    found |= dict.fromkeys(["s2_header", "s4_missing_file", "s5_blank_lines", "s8_trailing_space"], plain)
    found["s6_s7_refused_lines"] = "select * from (values ('too few fields', true), ('too many fields', true), ('no integer', true), ('beyond its type', true), ('none', false)) t(line, refused)"
    found["s9_printsize"] = f"select 'Tc' as relation, cast(count(*) as bigint) as size from ({found['tc']}) t"
    found["s10_output"] = "select distinct n_regionkey || '|' || n_name || '!' as line from nation"
    found["s12_command_stream"] = found["tc"]
    found["a4_lattice_check"] = "select * from (values ('cc', 'match(1)'), ('sssp', 'match(1)')) t(program, verdict)"
    found["s14_declared_scan"] = "select cast(n_regionkey as integer) as region, count(*) as n, cast(max(n_nationkey) as bigint) as largest from nation group by n_regionkey order by n_regionkey limit 3"
    found["r9_early_stop"] = """select cast(arg_min(o_orderkey, (o_orderdate, o_orderkey)) as bigint) as source,
      cast(arg_max(o_orderkey, (o_orderdate, o_orderkey)) as bigint) as target, cast(count(*) - 1 as bigint) as length from orders group by o_custkey"""
    found["r9_path"] = """select cast(arg_min(o_orderkey, (o_orderdate, o_orderkey)) as bigint) as source,
      cast(arg_max(o_orderkey, (o_orderdate, o_orderkey)) as bigint) as target, string_agg(cast(o_orderkey as varchar), '>' order by o_orderdate, o_orderkey) as path from orders group by o_custkey"""
    return found
