"""What recursion over many rounds, and over large tables, costs."""

from pyspark.sql import functions as F

from rillstone.operators.bodies import Read, evaluate, order_atoms
from rillstone.operators.fixpoint import Evaluator
from rillstone.operators.search import shortest_lengths, shortest_paths
from rillstone.program import Program
from rillstone.runtime import adaptive, cut


def test_the_estimated_size_of_what_rounds_write_stays_bounded(spark):
    with adaptive(spark, False):
        rows = cut(spark.range(8).repartition(4, "id"))
        for _ in range(7):
            rows = cut(rows.join(rows.withColumnRenamed("id", "same").hint("merge"), rows.id == F.col("same")).select("id"))
        # the estimate of a join is the product of its sides': 2 to the power of some hundreds by now
        assert rows._jdf.queryExecution().analyzed().stats().sizeInBytes() < 1 << 63
        # the rows are whole, and dealt as they were
        assert sorted(r.id for r in rows.collect()) == list(range(8))
        assert "Exchange" not in rows.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()


def test_the_next_atom_is_the_one_that_multiplies_rows_least(spark):
    text = """.decl Step(x: int64, y: int64)
    .decl Use(x: int64, r: int64, y: int64)
    .decl Has(a: int64, r: int64, x: int64)
    .decl Out(x: int64, y: int64)
    .decl Seen(x: int64)
    Out(a, d) :- Step(b, c), Use(c, r, d), Has(a, r, b).
    Seen(x) :- Seen(x), Out(x, x)."""
    # Use is the smaller, but all its rows have the same r; each x of Step has one row
    use = spark.range(40).selectExpr("id as x", "7 as r", "id as y")
    step = spark.range(80).selectExpr("id as x", "id % 40 as y")
    has = spark.range(60).selectExpr("id as a", "7 as r", "id as x")
    program = Program.parse(text)
    evaluator = Evaluator(spark, program.analysis, {"Step": step, "Use": use, "Has": has})
    for name in ("Step", "Use", "Has"):
        evaluator._fix(evaluator.relations[name])
    rule = program.analysis.tree.rules[0]
    reads = [Read(r.frame(spark), r.rows, fanout=evaluator._fanout(r)) for r in (evaluator.relations[a.name] for a in rule.positive)]
    assert reads[1].fanout(("c1",)) == 40 and reads[0].fanout(("c0",)) < 1.5
    assert order_atoms(rule, reads, 2) == [2, 0, 1]
    rows = {(r.c0, r.c1) for r in evaluate(rule, reads, lambda name: None, ["bigint", "bigint"], 2).collect()}
    assert rows == {(a, a % 40) for a in range(60)}


def test_ways_from_one_search_in_few_jobs(spark):
    arcs = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(0, 20), (20, 2), (5, 5)], "x long, y long")
    pairs = spark.createDataFrame([(0, 12), (0, 2), (3, 3), (5, 6), (12, 0), (None, 1), (7, 99)], "source long, target long")
    sc = spark.sparkContext
    sc.setJobGroup("ways", "ways")
    found = {(r.source, r.target): r.path for r in shortest_paths(arcs, pairs).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("ways"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert found == {(0, 12): list(range(13)), (0, 2): [0, 1, 2], (3, 3): [3], (5, 6): [5, 6], (12, 0): None, (None, 1): None, (7, 99): None}
    assert jobs < 100
    nowhere = spark.createDataFrame([(4, 1), (None, None)], "source long, target long")
    assert {r.path for r in shortest_paths(arcs, nowhere).collect()} == {None}
    assert {r.length for r in shortest_lengths(arcs, spark.createDataFrame([(0, 12)], "source long, target long"), max_rounds=13).collect()} == {12}


def test_steps_do_not_multiply_the_variants_of_a_round(spark, monkeypatch):
    text = """.decl Arc(x: int64, y: int64)
    .decl Reach(x: int64)
    Reach(x) :- Arc(x, _), x < 1.
    Reach(y) :- Reach(x), Arc(x, y).
    Reach(y) :- Reach(x), Arc(y, x)."""
    seen, variant = [], Evaluator._delta_variant
    monkeypatch.setattr(Evaluator, "_delta_variant", lambda self, rule, i, read, *rest: seen.append(read.frame._jdf.queryExecution().analyzed().toString().count("LogicalRDD")) or variant(self, rule, i, read, *rest))
    arcs = spark.createDataFrame([(i, i + 1) for i in range(6)], "x long, y long")
    result = Program.parse(text).run(spark, {"Arc": arcs})
    assert sorted(r.x for r in result.relation("Reach").collect()) == list(range(7))
    # each variant reads a delta that was written, not the variants of the step before
    assert max(seen) == 1
