"""One small program for each operator of the rule language, over whole tables."""

from __future__ import annotations

from rillstone.library.facts import CHAIN, TRADE
from rillstone.library.programs import Query

NATION = "select cast(n_nationkey as bigint) as n, n_name as name, cast(n_regionkey as bigint) as r from nation"
SUPPLIER = "select cast(s_suppkey as bigint) as s, cast(s_nationkey as bigint) as n, cast(floor(s_acctbal) as bigint) as b from supplier"
CUSTOMER = "select cast(c_custkey as bigint) as c, cast(c_nationkey as bigint) as n, c_mktsegment as seg, cast(floor(c_acctbal) as bigint) as b from customer"
ORDERS = "select cast(o_orderkey as bigint) as o, cast(o_custkey as bigint) as c, o_orderstatus as st, o_orderpriority as pr, cast(cast(o_orderdate as date) as string) as d from orders"
ITEM = "select distinct cast(l_orderkey as bigint) as o, cast(l_partkey as bigint) as p, cast(l_suppkey as bigint) as s, cast(l_linenumber as bigint) as l from lineitem"
PART = "select cast(p_partkey as bigint) as p, p_brand as b, p_type as t, cast(p_size as bigint) as z from part"

N = ".decl Nation(n: int64, name: string, r: int64)\n"
S = ".decl Supplier(s: int64, n: int64, b: int64)\n"
C = ".decl Customer(c: int64, n: int64, seg: string, b: int64)\n"
O = ".decl Orders(o: int64, c: int64, st: string, pr: string, d: string)\n"  # noqa: E741
I = ".decl Item(o: int64, p: int64, s: int64, l: int64)\n"  # noqa: E741
P = ".decl Part(p: int64, b: string, t: string, z: int64)\n"


def _query(facts: dict[str, str], text: str, columns: tuple[str, ...], oracle: str, outputs: tuple[str, ...] = ("Out",)) -> Query:
    return Query(facts, text, outputs, oracle, columns, recursive=False)


_n, _s, _c, _o, _i, _p = {"Nation": NATION}, {"Supplier": SUPPLIER}, {"Customer": CUSTOMER}, {"Orders": ORDERS}, {"Item": ITEM}, {"Part": PART}

OPERATORS: dict[str, Query] = {
    "p1_copy": _query(_n, N + ".decl Out(n: int64, name: string, r: int64)\nOut(a, b, c) :- Nation(a, b, c).", ("n", "name", "r"), "select n, name, r from nation"),
    "p2_permute": _query(_s, S + ".decl Out(b: int64, s: int64, n: int64)\nOut(b, s, n) :- Supplier(s, n, b).", ("b", "s", "n"), "select b, s, n from supplier"),
    "p3_project": _query(_c, C + ".decl Out(n: int64, seg: string)\nOut(n, g) :- Customer(_, n, g, _).", ("n", "seg"), "select distinct n, seg from customer"),
    "p4_repeat_in_head": _query(_s, S + ".decl Out(s: int64, t: int64, n: int64)\nOut(s, s, n) :- Supplier(s, n, _).", ("s", "t", "n"), "select s, s as t, n from supplier"),
    "p5_constant_in_head": _query(_s, S + ".decl Out(s: int64, k: string, m: int64)\nOut(s, \"rich\", -1) :- Supplier(s, _, b), b > 5000.", ("s", "k", "m"), "select s, 'rich' as k, cast(-1 as bigint) as m from supplier where b > 5000"),
    "p6_constant_in_atom": _query(_o, O + ".decl Out(o: int64)\nOut(o) :- Orders(o, _, \"F\", \"1-URGENT\", _).", ("o",), "select o from orders where st = 'F' and pr = '1-URGENT'"),
    "p7_constant_in_negation": _query(_o, O + ".decl Out(o: int64)\nOut(o) :- Orders(o, c, _, _, _), !Orders(o, _, \"F\", _, _).", ("o",), "select o from orders where st <> 'F'"),
    "p8_unequal": _query(_o, O + ".decl Out(o: int64, c: int64)\nOut(o, c) :- Orders(o, c, s, p, _), s != \"O\", o != c, p != \"5-LOW\".", ("o", "c"), "select o, c from orders where st <> 'O' and o <> c and pr <> '5-LOW'"),
    "p9_equal": _query(_c, C + ".decl Out(c: int64, n: int64)\nOut(c, n) :- Customer(c, n, g, _), g = \"BUILDING\", n = 7.", ("c", "n"), "select c, n from customer where seg = 'BUILDING' and n = 7"),
    "p10_greater": _query(_i, I + ".decl Out(o: int64, p: int64)\nOut(o, p) :- Item(o, p, s, l), s * 10 + l > p + 5.", ("o", "p"), "select distinct o, p from item where s * 10 + l > p + 5"),
    "p11_string_less": _query(_o, O + ".decl Out(o: int64)\nOut(o) :- Orders(o, _, _, _, d), d < \"1998-06-01\".", ("o",), "select o from orders where d < '1998-06-01'"),
    "p12_arithmetic": _query(_s, S + ".decl Out(s: int64, v: int64)\nOut(s, (b + n) * 2 - s) :- Supplier(s, n, b).", ("s", "v"), "select s, (b + n) * 2 - s as v from supplier"),
    "p13_choice_and_bounds": _query(_c, C + ".decl Out(c: int64)\nOut(c) :- Customer(c, n, g, b), (n <= 3; n >= 20, g = \"MACHINERY\"), b >= 0.", ("c",), "select c from customer where (n <= 3 or (n >= 20 and seg = 'MACHINERY')) and b >= 0"),
    "p13_binding_by_equality": _query(_s, S + ".decl Out(s: int64, k: int64)\nOut(s, k) :- Supplier(s, n, _), k = n * 100 + s % 7.", ("s", "k"), "select s, n * 100 + s % 7 as k from supplier"),
    "p14_coalesce_by_rules": _query(_o, O + ".decl Out(o: int64, v: string)\nOut(o, p) :- Orders(o, _, _, p, _), p != \"4-NOT SPECIFIED\".\nOut(o, s) :- Orders(o, _, s, \"4-NOT SPECIFIED\", _).", ("o", "v"), "select o, coalesce(nullif(pr, '4-NOT SPECIFIED'), st) as v from orders"),
    "j1_binary": _query(_o | _c, O + C + ".decl Out(o: int64, seg: string)\nOut(o, g) :- Orders(o, c, _, _, _), Customer(c, _, g, _).", ("o", "seg"), "select o, seg from orders join customer using (c)"),
    "j2_self": _query(_s, S + ".decl Out(a: int64, b: int64)\nOut(a, b) :- Supplier(a, n, _), Supplier(b, n, _), a < b.", ("a", "b"), "select x.s as a, y.s as b from supplier x join supplier y on x.n = y.n and x.s < y.s"),
    "j3_multiway": _query(
        _o | _c | _i | _s | _n | _p,
        O + C + I + S + N + P + ".decl Out(name: string, sname: string, brand: string)\nOut(x, y, b) :- Item(o, p, s, _), Orders(o, c, _, _, _), Customer(c, n, _, _), Nation(n, x, _), Supplier(s, m, _), Nation(m, y, _), Part(p, b, _, _).",
        ("name", "sname", "brand"),
        "select distinct a.name, z.name as sname, part.b as brand from item i join orders using (o) join customer on customer.c = orders.c join nation a on a.n = customer.n join supplier on supplier.s = i.s join nation z on z.n = supplier.n join part on part.p = i.p",
    ),
    "j4_two_keys": _query(_i | _o, I + O + ".decl Out(o: int64, l: int64)\nOut(o, l) :- Item(o, p, s, l), Item(o, q, s, l), p != q.", ("o", "l"), "select distinct x.o, x.l from item x join item y on x.o = y.o and x.s = y.s and x.l = y.l and x.p <> y.p"),
    "j5_cyclic": _query({"Arc": TRADE}, ".decl Arc(x: int64, y: int64, w: int64)\n.decl Out(x: int64, y: int64, z: int64)\nOut(x, y, z) :- Arc(x, y, _), Arc(y, z, _), Arc(z, x, _), x < y, y < z.", ("x", "y", "z"), "select distinct a.x, a.y, b.y as z from arc a join arc b on a.y = b.x join arc c on b.y = c.x and c.y = a.x where a.x < a.y and a.y < b.y"),
    "j6_intersection": _query(_c | _s, C + S + ".decl Out(n: int64)\nOut(n) :- Customer(_, n, \"MACHINERY\", _), Supplier(_, n, _).", ("n",), "select n from customer where seg = 'MACHINERY' intersect select n from supplier"),
    "j7_semi": _query(_c | _o, C + O + ".decl Out(c: int64, n: int64)\nOut(c, n) :- Customer(c, n, _, _), Orders(_, c, \"P\", _, _).", ("c", "n"), "select c, n from customer where c in (select c from orders where st = 'P')"),
    "j8_cross": _query(_n | {"Region": "select cast(r_regionkey as bigint) as r from region"}, N + ".decl Region(r: int64)\n.decl Out(n: int64, r: int64)\nOut(n, q) :- Nation(n, _, r), Region(q), r != q.", ("n", "r"), "select n, region.r from nation, region where nation.r <> region.r"),
    "j9_theta": _query(_o, O + ".decl Out(a: int64, b: int64)\nOut(a, b) :- Orders(a, c, _, _, d), Orders(b, c, _, _, e), d < e, a > b.", ("a", "b"), "select x.o as a, y.o as b from orders x join orders y on x.c = y.c and x.d < y.d and x.o > y.o"),
    "j10_anti": _query(_c | _o, C + O + ".decl Out(c: int64)\nOut(c) :- Customer(c, _, _, _), !Orders(_, c, \"F\", \"1-URGENT\", _).", ("c",), "select c from customer where c not in (select c from orders where st = 'F' and pr = '1-URGENT')"),
    "j11_anti_before_binding": _query(_s | _c, S + C + ".decl Rich(n: int64)\n.decl Out(s: int64)\nRich(n) :- Customer(_, n, _, b), b > 9900.\nOut(s) :- !Rich(n), Supplier(s, n, _).", ("s",), "select s from supplier where n not in (select n from customer where b > 9900)"),
    "j12_two_anti": _query(_p | _i | _s, P + I + S + ".decl Sold(p: int64)\n.decl Large(p: int64)\n.decl Out(p: int64)\nSold(p) :- Item(_, p, _, 7).\nLarge(p) :- Part(p, _, _, z), z > 40.\nOut(p) :- Part(p, _, _, _), !Sold(p), !Large(p).", ("p",), "select p from part where z <= 40 and p not in (select p from item where l = 7)"),
    "j13_not_exists": _query(_o | _i, O + I + ".decl Out(o: int64)\nOut(o) :- Orders(o, _, _, _, _), !Item(o, _, _, 1).", ("o",), "select o from orders where not exists (select 1 from item where item.o = orders.o and item.l = 1)"),
    "a5_cardinality": _query(_i, I + ".decl Out(n: int64)\nOut(count(p)) :- Parts(p).\n.decl Parts(p: int64)\nParts(p) :- Item(_, p, _, _).", ("n",), "select count(distinct p) as n from item"),
    "a6_max_with_default": _query(_o | _c, O + C + ".decl Day(c: int64, d: string)\n.decl Out(c: int64, d: string)\nDay(c, d) :- Orders(_, c, _, _, d).\nDay(c, \"\") :- Customer(c, _, _, _).\nOut(c, max(d)) :- Day(c, d).", ("c", "d"), "select c, max(d) as d from (select c, d from orders union all select c, '' from customer) t group by c"),
    "a7_distinct_heads": _query(_o, O + ".decl Out(st: string, pr: string)\nOut(s, p) :- Orders(_, _, s, p, _).", ("st", "pr"), "select distinct st, pr from orders"),
    "a_sum": _query(_c, C + ".decl Out(n: int64, b: int64)\nOut(n, sum(b)) :- Customer(_, n, _, b).", ("n", "b"), "select n, cast(sum(b) as bigint) as b from customer group by n"),
    "set_union": _query(_c | _s, C + S + ".decl Out(n: int64)\nOut(n) :- Customer(_, n, _, b), b < 0.\nOut(n) :- Supplier(_, n, b), b < 0.", ("n",), "select n from customer where b < 0 union select n from supplier where b < 0"),
    "set_difference": _query(_c | _s, C + S + ".decl Has(n: int64)\n.decl Out(c: int64, n: int64)\nHas(n) :- Supplier(_, n, b), b > 5000.\nOut(c, n) :- Customer(c, n, _, _), !Has(n).", ("c", "n"), "select c, n from customer where n not in (select n from supplier where b > 5000)"),
    "strings_cat": _query(_p, P + ".decl Out(v: string)\nOut(cat(b, cat(\" \", t))) :- Part(_, b, t, _).", ("v",), "select distinct b || ' ' || t as v from part"),
    "r9_frontier": Query(
        {"Arc": CHAIN, "Param": "select cast(min(o_orderkey) as bigint) as x from orders"},
        ".decl Arc(x: int64, y: int64)\n.decl Param(x: int64)\n.decl Level(x: int64, d: int64)\nLevel(x, 0) :- Param(x).\nLevel(y, min(d + 1)) :- Level(x, d), Arc(x, y).",
        ("Level",),
        "level(x, d) as (select x, cast(0 as bigint) from param union select arc.y, d + 1 from level join arc on arc.x = level.x) select x, min(d) as d from level group by x",
        ("x", "d"),
    ),
}
