"""The guard decides on the parsed tree: what it lets through, what it refuses, and how names follow nesting."""

import pytest

from lumenfold.sources import guard
from lumenfold.sources.schemas import TABLES

COLUMNS = ", ".join(f"product_id AS c{k}" for k in range(60))
FINE = [
    "select 1",
    "select * from orders",
    "table orders",
    "with a as (select * from orders), b as (select * from a) select * from b join A using (product_id)",
    "with a as (with b as (select * from orders) select * from b) select * from a",
    "with y as (select 1 z), x as (select * from y) select * from x where z in (select z from y) and exists (select 1 from orders)",
    "with recursive r as (select 1 n union all select n + 1 from r where n < 5) select * from r",
    "with orders as (select 1 q) select q from orders",
    "select (with a as (select max(quantity) m from orders) select m from a) from products",
    f"select {COLUMNS}, sum(quantity) as q, {COLUMNS} from orders group by all",
    "select product_id, sum(revenue) over (partition by product_id order by order_date rows between 3 preceding and current row) s from orders",
    "select product_id, rank() over w from orders window w as (partition by product_id order by order_date)",
    "select case when quantity between 1 and 3 then 'a' else null end, cast(quantity as double), order_date + interval 1 day, date '2024-01-01', -quantity from orders"
    " where status like 'p%' and product_id in ('a', 'b') and not (quantity is null) group by all having count(*) > 1 order by 1 desc limit 3",
    "select count(distinct product_id) filter (where quantity > 1), extract(year from order_date), trim(both 'x' from status) from orders left join traffic t on t.date = order_date",
    "select * from values (1, 'a'), (2, 'b') t(a, b)",
    "select product_id, grouping(product_id), count(*) from orders group by rollup(product_id)",
    "select status from orders union all (select status from orders intersect select status from orders) except select 'x'",
    "select :a + 1, quantity % 2, quantity div 2, status || 'a', quantity <=> 1, true from orders",
]
REFUSED = [
    # a literal that looks like a named query
    "SELECT 'CTE [other]' AS a, id FROM other",
    "select 'UnresolvedWith [other]' a from other",
    # a name of a nested WITH is not known outside it
    "select * from (with other as (select 1) select * from other) a join other on true",
    "with x as (with other as (select 1) select * from other) select * from other",
    "select (with other as (select 1 m) select m from other), id from other",
    # nor before it, nor to itself
    "with x as (select * from y), y as (select 1 z) select * from x",
    "with other as (select * from other) select * from other",
    # in the middle of a long list, in windows, subqueries, orders and conditions
    f"select {COLUMNS}, reflect('java.lang.System', 'getenv', 'PATH'), {COLUMNS} from orders",
    "select rank() over w from orders window w as (order by reflect('a', 'b'))",
    "select rank() over (partition by java_method('a', 'b') order by 1) from orders",
    "select (select max(x.a) from (select 1 a from other) x) from orders",
    "select 1 from orders where exists (select 1 from other)",
    "select 1 from orders where product_id in (select id from other)",
    "select sum(quantity) filter (where reflect('a', 'b') = 'x') from orders",
    "select 1 from orders order by reflect('a', 'b')",
    "select 1 from orders group by reflect('a', 'b')",
    "select 1 from orders join products on reflect('a', 'b') = 'x'",
    "select * from values (1, reflect('a', 'b')) t(a, b)",
    # other ways to read, and functions of the session
    "select * from parquet.`/etc`",
    "select * from default.orders",
    "select * from identifier('orders')",
    "select * from range(5)",
    "select explode(array(1, 2)) from orders",
    "select * from orders lateral view explode(array(1)) t as x",
    "select input_file_name() from orders",
    "select current_user",
    "select `session_user` from orders",
    "select system.builtin.abs(1)",
    # not a query, or more than one
    "insert into orders select * from orders",
    "create view x as select 1",
    "create temporary view x as select 1",
    "cache table orders",
    "set x = 1",
    "explain select 1",
    "show tables",
    "describe orders",
    "select 1; select 2",
    "",
    "selec 1",
]


@pytest.mark.parametrize("sql", FINE)
def test_queries_over_the_tables_pass(spark, sql):
    guard.check(spark, sql, TABLES)


@pytest.mark.parametrize("sql", REFUSED)
def test_everything_else_is_refused(spark, sql):
    with pytest.raises(PermissionError):
        guard.check(spark, sql, TABLES)


def test_deep_conditions_are_walked(spark):
    sql = "select 1 from orders where " + " or ".join(f"quantity = {k}" for k in range(500))
    guard.check(spark, sql, TABLES)
    with pytest.raises(PermissionError):
        guard.check(spark, f"{sql} or reflect('a', 'b') = 'x'", TABLES)
