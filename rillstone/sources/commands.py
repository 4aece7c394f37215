"""Facts as a stream of commands: one transaction of inserts to a file.

    start;
    insert Arc(1, 2);
    insert Name(1, "a \\"b\\"");
    commit;
    dump RelationSizes;

Lines are read and parsed by Spark. The inserts of a file are one batch: they
take effect together, at its `commit`. `timestamp` is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.program import Result
from rillstone.sources.facts import size_line

#: Words of the command language: fixed values of the format.
START, INSERT, COMMIT, DUMP, TIMESTAMP = "start;", "insert", "commit;", "dump RelationSizes;", "timestamp;"


def _literal(c: str, kind: str) -> Column:
    cell = F.col(f"`{c}`").cast("string")
    if kind != "string":
        return cell
    return F.concat(F.lit('"'), F.replace(F.replace(cell, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def inserts(frame: DataFrame, relation: str) -> DataFrame:
    """An insert command for each row."""
    cells = [_literal(name, kind) for name, kind in frame.dtypes]
    return frame.select(F.concat(F.lit(f"{INSERT} {relation}("), F.concat_ws(", ", *cells), F.lit(");")).alias("value"))


def write_commands(facts: dict[str, DataFrame], path: str) -> None:
    """One transaction that inserts all rows of `facts`: a folder whose files, in order of their names, are the stream."""
    frames = [f.sparkSession.createDataFrame([(line,)], "value string").coalesce(1) for f in list(facts.values())[:1] for line in (START,)]
    frames += [inserts(frame, name) for name, frame in facts.items()]
    spark = frames[0].sparkSession
    frames.append(spark.createDataFrame([(COMMIT,), (DUMP,)], "value string").coalesce(1))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    out.write.mode("overwrite").text(path)


def read_commands(spark: SparkSession, path: str, types: dict[str, list[str]]) -> tuple[dict[str, DataFrame], bool]:
    """The rows that one transaction inserts, by relation, and whether it asks for sizes.

    `types` are the columns' types by relation. Text that is no command, an
    undeclared relation, a wrong number of fields, a field of the wrong type,
    or other than one `commit` is an error.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    name = F.regexp_extract("value", rf"^{INSERT}\s+(\w+)\(.*\);$", 1)
    plain = F.col("value").isin(START, COMMIT, DUMP, TIMESTAMP)
    told = lines.where(plain).groupBy("value").count().collect()
    found = {r["value"]: r["count"] for r in told}
    if found.get(COMMIT, 0) != 1:
        raise ValueError(f"{path}: {found.get(COMMIT, 0)} commits, not one")
    bad = lines.where(~plain & ~name.isin(*types)).limit(1).collect()
    if bad:
        raise ValueError(f"{path}: {bad[0]['value']}")
    facts = {}
    for relation, kinds in types.items():
        inner = F.regexp_extract("value", rf"^{INSERT}\s+{relation}\((.*)\);$", 1)
        rows = lines.where(name == relation).select("value", inner.alias("inner"))
        schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds))
        options = {"sep": ",", "quote": '"', "escape": "\\", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "FAILFAST", "emptyValue": ""}
        # commas outside of quoted strings part the fields
        fields = F.size(F.split(F.regexp_replace("inner", r'"(?:\\.|[^"\\])*"', "s"), ","))
        wrong = F.raise_error(F.concat(F.lit(f"{len(kinds)} fields wanted: "), F.col("value"))).cast("boolean")
        rows = rows.where(F.when(fields != len(kinds), wrong).otherwise(F.lit(True)))
        cells = [F.coalesce(F.col(f"row.c{i}"), F.lit("")).alias(f"c{i}") if kind == "string" else F.col(f"row.c{i}") for i, kind in enumerate(kinds)]
        facts[relation] = rows.select(F.from_csv("inner", schema, options).alias("row")).select(*cells)
    return facts, DUMP in found


def run_commands(result: Result, path: str) -> list[str]:
    """Applies one transaction to a program's result; the size lines, where it asks for them."""
    spark, tree = result.evaluator.spark, result.tree
    types = {name: result.evaluator.program.types[name] for name in tree.inputs or tree.schemas}
    facts, dump = read_commands(spark, path, types)
    result.extend(facts)
    return [size_line(name, result.evaluator.size(name)) for name in sorted(tree.schemas)] if dump else []
