"""Input relations derived from whole tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

#: A tree over all customers: from half the key, down, to the key.
TREE = "select cast(floor(c_custkey / 2) as bigint) as x, cast(c_custkey as bigint) as y from customer where c_custkey > 0"
#: Each order of a customer to the customer's next one.
CHAIN = """select x, y from (select cast(o_orderkey as bigint) as x,
  cast(lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as y from orders) t where y is not null"""
#: Each event of a user to the user's next one.
FLOW = """select x, y from (select cast(event_id as bigint) as x,
  cast(lead(event_id) over (partition by user_id order by ts, event_id) as bigint) as y from events) t where y is not null"""
#: Regions to nations to suppliers.
PLACES = """select cast(n_regionkey as bigint) as x, cast(100 + n_nationkey as bigint) as y from nation
  union select cast(100 + s_nationkey as bigint), cast(1000 + s_suppkey as bigint) from supplier"""
#: Nations whose suppliers sold to others' customers, by the least quantity.
TRADE = """select cast(s_nationkey as bigint) as x, cast(c_nationkey as bigint) as y, cast(min(floor(l_quantity)) as bigint) as w
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey
  group by s_nationkey, c_nationkey"""


def supplier_tree(fan: int) -> str:
    """Suppliers, and those whose key is theirs divided by `fan`."""
    return f"select cast(s_suppkey as bigint) as x, cast(floor(s_suppkey / {fan}) as bigint) as y from supplier where s_suppkey > 0"


SUPPLIER_CELL = "select cast(s_suppkey as bigint) as x, cast(100000 + s_nationkey as bigint) as y from supplier"
SUPPLIER_FIELD = "select cast(s_suppkey as bigint) as x, cast(floor(s_suppkey / {fan}) as bigint) as y, cast(s_nationkey % 3 as bigint) as f from supplier"
