"""Every query of the engine's own operators, bound to the test tables, with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import lines, marks, names
from tallyloom.functions.tables import CLASSES
from tallyloom.operators import aggregates, entity, joins, patches, quality, query, windows
from tallyloom.operators.stages import spread
from tallyloom.plans import documents, pages, profiles, upkeep  # noqa: F401  they register their queries
from tallyloom.plans.registry import ORACLE_SQL, QUERIES, Tables, register  # noqa: F401
from tallyloom.sources import readers
from tallyloom.streaming import sessions


ORDER_PAGE = query.Spec(equals={"o_orderstatus": "F", "o_orderpriority": None}, at_least={"o_totalprice": 1000.0}, order=(("o_totalprice", True), ("o_orderkey", False)), limit=100, offset=100)


@register("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET 100")
def faceted_page(t: Tables) -> DataFrame:
    return query.page(t.orders, ORDER_PAGE, "o_orderkey")


@register("SELECT count(*) AS n, CAST(ceil(count(*) / 100.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def faceted_count(t: Tables) -> DataFrame:
    return query.count(t.orders, ORDER_PAGE)


@register("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%ri%' OR p_brand ILIKE '%ri%'")
def contains_search(t: Tables) -> DataFrame:
    return t.part.filter(query.predicate(query.Spec(contains={"ri": ["p_name", "p_brand"]}))).select("p_partkey", "p_name", "p_brand")


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def nocase_equality(t: Tables) -> DataFrame:
    return t.customer.filter(query.predicate(query.Spec(nocase={"c_mktsegment": "building"}))).select("c_custkey", "c_mktsegment")


@register("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12 AND l_linenumber <= 3")
def range_bounds(t: Tables) -> DataFrame:
    spec = query.Spec(at_least={"l_quantity": 10.0}, at_most={"l_quantity": 12.0, "l_linenumber": 3})
    return t.lineitem.filter(query.predicate(spec)).select("l_orderkey", "l_linenumber", "l_quantity")


@register("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77 LIMIT 1")
def point_lookup(t: Tables) -> DataFrame:
    return t.customer.filter("c_custkey = 77").select("c_custkey", "c_name").limit(1)


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' AND nullif(l_linenumber, 7) IS NOT NULL) AND l_linestatus IN ('F')")
def negated_conjunction(t: Tables) -> DataFrame:
    relay, leg = F.col("l_returnflag") == "R", F.nullif("l_linenumber", F.lit(7))
    return t.lineitem.filter(~(relay & leg.isNotNull()) & F.col("l_linestatus").isin("F")).select("l_orderkey", "l_linenumber")


@register("SELECT a.l_orderkey, a.l_partkey FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, nullif(l_linenumber, 7) AS p FROM lineitem WHERE l_linenumber >= 6) b ON a.l_orderkey = b.l_orderkey AND nullif(a.l_linenumber, 7) IS NOT DISTINCT FROM b.p")
def null_safe_match(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("p", F.nullif("l_linenumber", F.lit(7)))
    other = rows.filter("l_linenumber >= 6").select("l_orderkey", "p").distinct()
    return joins.null_safe_match(rows, other, ["l_orderkey"], ["p"]).select("l_orderkey", "l_partkey")


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(nullif(l_linenumber, 7) > 3 OR l_returnflag = 'R', false)")
def topk_retention(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("place", F.nullif("l_linenumber", F.lit(7)))
    return query.retain_top(rows, "place", 3, F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@register("""SELECT s_suppkey, s_name, n_name, count(*) AS n, count(DISTINCT year(l_shipdate)) AS n_years, CAST(min(year(l_shipdate)) AS INTEGER) AS first_year, CAST(max(year(l_shipdate)) AS INTEGER) AS last_year
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE s_name ILIKE '%1%' GROUP BY 1, 2, 3 ORDER BY n DESC, s_suppkey LIMIT 50""")
def dim_search_rollup(t: Tables) -> DataFrame:
    year = F.year("l_shipdate")
    # the dimension is searched first: only its matches' rows are aggregated, by key, before its columns join
    named = t.supplier.filter(F.col("s_name").ilike("%1%")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey").join(named.select("s_suppkey"), "s_suppkey", "left_semi")
    rolled = rows.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.count_distinct(year).alias("n_years"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return rolled.join(named, "s_suppkey").select("s_suppkey", "s_name", "n_name", "n", "n_years", "first_year", "last_year").orderBy(F.desc("n"), "s_suppkey").limit(50)


@register("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_assign(t: Tables) -> DataFrame:
    return joins.lookup(t.orders.select("o_orderkey", "o_custkey"), t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), ["o_custkey"]).select("o_orderkey", "o_custkey", "c_mktsegment")


@register("""SELECT o_custkey, count(*) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def semi_join_group(t: Tables) -> DataFrame:
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    return t.orders.join(urgent, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"), aggregates.joined_set("o_orderpriority").alias("priorities"))


@register("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_check(t: Tables) -> DataFrame:
    return joins.orphans(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


RANGES = [("F", 1993, 1995, 1, "early"), ("F", 1995, 1997, 2, "middle"), ("O", 1996, None, 1, "open"), ("O", 1990, 1999, 2, "closed"), ("P", 1998, 1997, 1, "never")]


@register("""WITH ranges(s, a, b, ordinal, label) AS (VALUES ('F', 1993, 1995, 1, 'early'), ('F', 1995, 1997, 2, 'middle'), ('O', 1996, NULL, 1, 'open'), ('O', 1990, 1999, 2, 'closed'), ('P', 1998, 1997, 1, 'never'))
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, (SELECT arg_min(label, ordinal) FROM ranges WHERE s = o_orderstatus AND year(o_orderdate) >= a AND (b IS NULL OR year(o_orderdate) <= b)) AS label FROM orders""")
def interval_lookup_first(t: Tables) -> DataFrame:
    ranges = t.spark.createDataFrame(RANGES, "o_orderstatus string, start int, end int, ordinal int, label string")
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    return joins.interval_lookup(rows, ranges, "year", ["o_orderstatus"], "label", 1980, 2030).select("o_orderkey", "year", "label")


@register("""SELECT a.c_nationkey AS nation, a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey
WHERE substr(a.c_name, 1, 1) = substr(b.c_name, 1, 1) AND levenshtein(a.c_name, b.c_name) <= 1""")
def blocked_fuzzy_pairs(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), F.substring("c_name", 1, 1).alias("initial"), "c_custkey", "c_name")
    return entity.one_edit_pairs(rows, "c_custkey", ["nation", "initial"], "c_name").select("nation", F.col("a_c_custkey").alias("a"), F.col("b_c_custkey").alias("b"))


@register("""SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS members FROM lineitem GROUP BY 1 HAVING count(*) <> 4""")
def team_members(t: Tables) -> DataFrame:
    return joins.teams(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey"]).filter("n <> 4")


@register("SELECT o_custkey, count(*) AS n, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year FROM orders GROUP BY 1")
def group_span(t: Tables) -> DataFrame:
    return aggregates.spans(t.orders, ["o_custkey"], F.year("o_orderdate"))


@register("""SELECT l_orderkey, l_suppkey, count(DISTINCT l_linenumber) AS n_values, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS value_list FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber) > 1""")
def multi_place_conflict(t: Tables) -> DataFrame:
    return aggregates.conflicts(t.lineitem, ["l_orderkey", "l_suppkey"], "l_linenumber")


@register("""SELECT l_orderkey, l_returnflag, CAST(unnest(range(n + 1, 9)) AS INTEGER) AS slot FROM
(SELECT l_orderkey, l_returnflag, CASE WHEN l_returnflag = 'R' THEN count(DISTINCT l_linenumber) ELSE count(*) END AS n FROM lineitem GROUP BY 1, 2) WHERE n < 8""")
def missing_slots(t: Tables) -> DataFrame:
    n = F.when(F.col("l_returnflag") == "R", F.count_distinct("l_linenumber")).otherwise(F.count("*"))
    return aggregates.missing_slots(t.lineitem, ["l_orderkey", "l_returnflag"], n)


@register("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) = 4")
def exact_cardinality(t: Tables) -> DataFrame:
    return aggregates.exact_groups(t.lineitem, ["l_orderkey"], 4)


@register("SELECT DISTINCT 'priority' AS facet, o_orderpriority AS value FROM orders UNION ALL SELECT DISTINCT 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders")
def distinct_facets(t: Tables) -> DataFrame:
    pair = F.array(F.struct(F.lit("priority").alias("facet"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("year").alias("facet"), F.year("o_orderdate").cast("string").alias("value")))
    return t.orders.select(F.inline(pair)).distinct()


BEST = "SELECT {key}, l_extendedprice, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN asc_ THEN l_extendedprice ELSE -l_extendedprice END, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS r FROM ({rows})) WHERE r = 1"
BEST_COLUMNS = ["l_partkey", "l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey"]
BEST_TIES = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]


@register(BEST.format(key="l_partkey", rows="SELECT *, l_partkey % 2 = 0 AS asc_ FROM lineitem"))
def best_by_direction(t: Tables) -> DataFrame:
    return aggregates.best(t.lineitem, ["l_partkey"], "l_extendedprice", BEST_TIES, F.col("l_partkey") % 2 == 0).select(*BEST_COLUMNS)


@register(BEST.format(key="l_partkey", rows="SELECT *, first_value(l_extendedprice) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) < 30000 AS asc_ FROM lineitem"))
def best_by_threshold(t: Tables) -> DataFrame:
    rows = aggregates.by_first_mark(t.lineitem, ["l_partkey"], "l_extendedprice", BEST_TIES, 30_000)
    return aggregates.best(rows, ["l_partkey"], "l_extendedprice", BEST_TIES, F.col("ascending")).select(*BEST_COLUMNS)


@register("""SELECT l_suppkey, count(*) FILTER (l_linenumber = 1) AS gold, count(*) FILTER (l_linenumber = 2) AS silver, count(*) FILTER (l_linenumber = 3) AS bronze, count(*) FILTER (l_linenumber <= 5) AS top, count(*) AS total FROM lineitem GROUP BY 1""")
def placing_summary(t: Tables) -> DataFrame:
    return aggregates.placings(t.lineitem, ["l_suppkey"], "l_linenumber", 5)


@register("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
def notable_top20(t: Tables) -> DataFrame:
    return aggregates.notable(t.orders, "o_custkey")


@register("SELECT l_partkey, l_returnflag AS mode, n FROM (SELECT l_partkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def mode_with_ties(t: Tables) -> DataFrame:
    return aggregates.modes(t.lineitem, ["l_partkey"], "l_returnflag")


@register("""SELECT l_orderkey, CAST(min(e) AS INTEGER) AS expected, CAST(arg_min(l_linenumber, e) AS INTEGER) AS got FROM
(SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS e, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE e <> l_linenumber AND n > 1 GROUP BY 1""")
def rank_gap(t: Tables) -> DataFrame:
    return windows.rank_gaps(t.lineitem, ["l_orderkey"], "l_linenumber")


@register("""SELECT l_orderkey, l_linenumber, l_quantity, previous FROM (SELECT *, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS previous FROM lineitem) WHERE l_quantity < previous""")
def lag_monotonic(t: Tables) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return windows.out_of_order(t.lineitem, ["l_orderkey"], order, "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity", "previous")


@register("""WITH days AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS day FROM events WHERE event_type = 'purchase'),
marked AS (SELECT *, CASE WHEN day - lag(day) OVER w > 5 OR lag(day) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM days WINDOW w AS (PARTITION BY user_id ORDER BY day)),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY day) AS BIGINT) AS cluster FROM marked)
SELECT user_id, cluster, min(day) AS first, max(day) AS last, count(*) AS n FROM numbered GROUP BY 1, 2""")
def gap_clusters(t: Tables) -> DataFrame:
    days = t.events.filter("event_type = 'purchase'").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day"))
    return windows.gap_clusters(days, ["user_id"], "day", 5)


@register("""WITH have AS (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS day FROM orders),
missing AS (SELECT CAST(d AS INTEGER) AS day FROM (SELECT unnest(range((SELECT min(day) FROM have), (SELECT max(day) FROM have) + 1)) AS d) WHERE d NOT IN (SELECT day FROM have)),
keyed AS (SELECT day, day - row_number() OVER (ORDER BY day) AS island FROM missing)
SELECT min(day) AS first, max(day) AS last FROM keyed GROUP BY island""")
def missing_islands(t: Tables) -> DataFrame:
    have = t.orders.select(F.unix_date(F.to_date("o_orderdate")).alias("day")).distinct()
    all_days = have.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return windows.islands(all_days.join(have, "day", "left_anti"), "day")


@register("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def carry_forward(t: Tables) -> DataFrame:
    return windows.carried(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("value")), "carried").select("event_id", "carried")


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def exact_duplicates(t: Tables) -> DataFrame:
    return quality.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")
def first_wins(t: Tables) -> DataFrame:
    return windows.first_wins(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS row_id FROM orders")
def stable_row_ids(t: Tables) -> DataFrame:
    return windows.numbered(t.orders.select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", F.col("row_id").cast("long").alias("row_id"))


@register("SELECT p_partkey FROM part WHERE p_size < 5 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def set_ops_union(t: Tables) -> DataFrame:
    return t.part.filter("p_size < 5").select("p_partkey").union(t.lineitem.filter("l_quantity > 49").select("l_partkey")).distinct()


@register("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def set_ops_except(t: Tables) -> DataFrame:
    return t.part.select("p_partkey").subtract(t.lineitem.filter("l_quantity > 40").select("l_partkey"))


@register("SELECT p_partkey FROM part WHERE p_size > 25 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05")
def set_ops_intersect(t: Tables) -> DataFrame:
    return t.part.filter("p_size > 25").select("p_partkey").intersect(t.lineitem.filter("l_discount > 0.05").select("l_partkey"))


@register("SELECT n_nationkey, CAST(unnest(range(n_regionkey, least(n_nationkey, 9) + 1)) AS INTEGER) AS year FROM nation WHERE n_regionkey <= least(n_nationkey, 9)")
def range_expansion(t: Tables) -> DataFrame:
    end = F.least(F.col("n_nationkey"), F.lit(9))
    return t.nation.filter(F.col("n_regionkey") <= end).select("n_nationkey", F.explode(F.sequence("n_regionkey", end)).alias("year"))


@register("""SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 0.3048 + (p_partkey % 12) * 0.0254 WHEN 1 THEN (p_size % 10) * 60 + (p_partkey % 60) + 0.25 WHEN 2 THEN p_size + 0.5 END, 6) AS num, p_partkey % 4 = 2 AS wind_aided, p_partkey % 8 = 5 AS converted FROM part""")
def parse_marks(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    time = F.concat((F.col("p_size") % 10).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("¼"), F.when(k % 8 == 5, F.lit("+")).otherwise(F.lit("")))
    text = F.when(k % 4 == 0, F.concat(F.lit("c"), size, F.lit("–"), (k % 12).cast("string"))).when(k % 4 == 1, time).when(k % 4 == 2, F.concat(size, F.lit("½W/"), size)).otherwise("nt")
    mark = marks.parse_mark(text)
    return t.part.select("p_partkey", F.round(mark["num"], 6).alias("num"), mark["wind_aided"].alias("wind_aided"), mark["converted"].alias("converted"))


@register("""SELECT c_custkey, CAST(c_custkey % 30 + 1 AS INTEGER) AS place, replace(c_name, '#', ' ') AS name, c_mktsegment AS school, CASE c_custkey % 4 WHEN 0 THEN 'freshman' WHEN 1 THEN 'sophomore' WHEN 2 THEN 'junior' WHEN 3 THEN 'senior' END AS class,
10 + c_custkey % 50 + 0.25 AS mark_num, c_custkey % 5 = 0 AS international, c_custkey % 11 = 0 AS converted, c_custkey % 3 = 0 AS wind_aided FROM customer""")
def result_lines(t: Tables) -> DataFrame:
    k, when = F.col("c_custkey"), lambda x, text: F.when(x, F.lit(text)).otherwise(F.lit(""))
    line = F.concat(
        when(k % 7 == 0, " ="), when(k % 11 == 0, "+"), (k % 30 + 1).cast("string"), F.lit(". "), F.replace("c_name", F.lit("#"), F.lit(" ")), when(k % 5 == 0, "’"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")"), when(k % 6 == 1, " (injured in heats)"),
        F.lit(" ..... "), F.element_at(F.array(*map(F.lit, ("Fr", "So", "Jr", "Sr"))), (k % 4 + 1).cast("int")), F.lit(" "), (k % 50 + 10).cast("string"), F.lit(".25"), when(k % 3 == 0, "w"), when(k % 9 == 4, " MR"),
    )
    customers = spread(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    found = customers.select("c_custkey", lines.placed(line).alias("p")).select("c_custkey", "p", lines.individual(F.col("p.rest"), CLASSES, {}).alias("r"))
    return found.select("c_custkey", "p.place", "r.name", "r.school", "r.class", "r.mark_num", "r.international", (F.col("p.converted") | F.col("r.converted")).alias("converted"), "r.wind_aided")


@register("""SELECT c_custkey, c_mktsegment AS school, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN 180 + c_custkey % 60 + 0.5 END AS mark_num, c_custkey % 5 = 3 AS is_dq FROM customer""")
def relay_lines(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    time = F.concat(F.lit("3:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(".5"))
    line = F.concat(F.col("c_mktsegment"), F.when(k % 5 == 0, F.concat(F.lit(" ...... "), time)).when(k % 5 == 1, F.concat(F.lit(" "), time)).when(k % 5 == 2, time).when(k % 5 == 3, F.lit(" DQ")).otherwise(F.lit("")))
    customers = spread(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return customers.select("c_custkey", lines.relay(line, {}).alias("r")).select("c_custkey", "r.school", "r.mark_num", "r.is_dq")


@register("""WITH marked AS (SELECT o_custkey % 50 AS doc, o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN 1900 + CAST(o_orderkey % 100 AS INTEGER) END AS y, CASE WHEN o_orderkey % 40 BETWEEN 1 AND 4 THEN o_orderpriority END AS d FROM orders),
numbered AS (SELECT *, count(y) OVER (PARTITION BY doc ORDER BY o_orderkey) AS section FROM marked)
SELECT doc, o_orderkey, last_value(y IGNORE NULLS) OVER (PARTITION BY doc, section ORDER BY o_orderkey) AS year, CASE WHEN last_value(d IGNORE NULLS) OVER (PARTITION BY doc, section ORDER BY o_orderkey) IS NOT NULL THEN 'June 7' END AS date,
CASE left(last_value(d IGNORE NULLS) OVER (PARTITION BY doc, section ORDER BY o_orderkey), 1) WHEN '1' THEN 'Eugene, Ore' WHEN '2' THEN 'Eugene, Ore' WHEN '3' THEN 'Austin' WHEN '4' THEN 'Austin' WHEN '5' THEN 'Austin' END AS location FROM numbered WHERE section > 0""")
def section_context(t: Tables) -> DataFrame:
    k, first = F.col("o_orderkey"), F.left("o_orderpriority", F.lit(1))
    place = F.when(first.isin("1", "2"), F.lit("(Eugene, Ore, June 7–9; wind +1.2)")).otherwise(F.lit("(Austin; June 7)"))
    line = F.when(k % 40 == 0, F.concat(F.lit("\f"), (1900 + k % 100).cast("string"))).when((k % 40).between(1, 4), place).otherwise(F.lit("3. A Runner (School) ..... Jr 10.25"))
    rows = t.orders.select((F.col("o_custkey") % 50).alias("doc"), "o_orderkey", line.alias("line"))
    rows = windows.sections(rows, ["doc"], ["o_orderkey"], lines.year_header(F.col("line")).isNotNull()).filter("section > 0")
    values = {"year": lines.year_header(F.col("line")), "date": lines.meet_date(F.col("line")), "location": lines.location(F.col("line"))}
    return windows.filled(rows, ["doc", "section"], ["o_orderkey"], values).select("doc", "o_orderkey", "year", "date", "location")


@register("""SELECT p_size, p_type, min(p_name) AS name, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS schools, count(*) AS performances, min(p_partkey % 40) AS first_year, max(p_partkey % 40) AS last_year FROM part
WHERE p_size IN (SELECT p_size FROM part WHERE p_name ILIKE '%ri%') GROUP BY 1, 2 ORDER BY name, p_size, p_type LIMIT 50""")
def athlete_search(t: Tables) -> DataFrame:
    found = aggregates.entity_search(t.part.withColumn("year", F.col("p_partkey") % 40), "p_size", "p_name", "p_brand", "p_type", "year", "ri")
    return found.withColumn("schools", F.array_join("schools", ","))


@register("SELECT l_orderkey, l_linenumber, l_partkey, secs FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN (l_orderkey % 50) * 60.0 + l_linenumber + 0.5 ELSE l_orderkey % 60 + 0.25 END AS secs FROM lineitem) ORDER BY secs, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100")
def duration_sort(t: Tables) -> DataFrame:
    minutes = F.concat((F.col("l_orderkey") % 50).cast("string"), F.lit(":0"), F.col("l_linenumber").cast("string"), F.lit(".5"))
    text = F.when(F.col("l_partkey") % 2 == 0, minutes).otherwise(F.concat((F.col("l_orderkey") % 60).cast("string"), F.lit(".25")))
    rows = t.lineitem.withColumn("secs", marks.duration_key(text))
    return rows.orderBy(F.col("secs").asc_nulls_last(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey", "secs")


@register("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'AUTOMOBILE' THEN 'Cars' ELSE c_mktsegment END AS segment FROM customer")
def alias_map(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", names.mapped(F.col("c_mktsegment"), {"BUILDING": "Construction", "AUTOMOBILE": "Cars"}).alias("segment"))


@register("SELECT doc_id, strip_accents(text) AS bare FROM documents WHERE regexp_full_match(text, '[\\x{09}-\\x{7E}À-ÿ]*')")
def strip_diacritics(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", names.strip_diacritics("text").alias("bare"))


@register("SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title[^>]*>([^<]*)</title>', 1)), '') AS title, CAST(len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS INTEGER) AS n_links FROM pages")
def html_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", readers.between_tags(F.col("html"), "title").alias("title"), F.size(readers.links(F.col("html"))).alias("n_links"))


@register("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, count(*) FILTER (regexp_matches(line, '[0-9]')) AS n_with_digits, CAST(max(length(line)) AS INTEGER) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def line_scan(t: Tables) -> DataFrame:
    return readers.lines(t.documents, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line").rlike("[0-9]")).alias("n_with_digits"), F.max(F.length("line")).alias("longest"))


@register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


ORDER_KEY = "o_orderkey long, o_orderpriority string, ordinal int"


@register("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey IN (3, 7) THEN 'fixed' WHEN o_orderkey = 5 THEN 'last' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE NOT (o_orderkey % 10 = 1 AND o_orderstatus = 'F')
UNION ALL SELECT -1, 'O', 'added'""")
def apply_patches(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").withColumn("m", F.col("o_orderkey") % 10)
    rows = patches.remove_rows(rows, t.spark.createDataFrame([(1, "F")], "m long, o_orderstatus string"), ["m"], ["o_orderstatus"]).drop("m")
    fixes = t.spark.createDataFrame([(3, "fixed", 1), (5, "first", 2), (7, "fixed", 3), (5, "last", 4)], ORDER_KEY)
    rows = patches.update_rows(rows, fixes, ["o_orderkey"], {"o_orderpriority": "o_orderpriority"})
    return patches.insert_missing(rows, t.spark.createDataFrame([(-1, "O", "added"), (3, "X", "not added")], "o_orderkey long, o_orderstatus string, o_orderpriority string"), ["o_orderkey"])


@register("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (1, 2) UNION ALL SELECT 1, 1, 11 UNION ALL SELECT 1, 2, 12 UNION ALL SELECT 2, 1, 21""")
def apply_patches_groups(t: Tables) -> DataFrame:
    members = t.spark.createDataFrame([(1, 1, 11), (1, 2, 12), (2, 1, 21)], "l_orderkey long, l_linenumber int, l_partkey long")
    return patches.replace_groups(t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey"), members, ["l_orderkey"])


@register("""SELECT o_orderkey, CASE WHEN o_orderkey = 3 THEN 'C' WHEN o_orderkey = 5 THEN 'B' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey = 3 THEN 'moved' WHEN o_orderkey = 7 THEN 'set' ELSE o_orderpriority END AS o_orderpriority FROM (
SELECT o_orderkey, CASE WHEN o_orderkey IN (3, 5, 7) THEN 'A' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders)""")
def apply_patches_chain(t: Tables) -> DataFrame:
    """Two patches of one key, of which the second finds what the first has set, and one that finds nothing any more."""
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey").isin(3, 5, 7), "A").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")
    fixes = [(3, 1, "A", "B", None), (3, 2, "B", "C", "moved"), (3, 3, "B", "lost", "lost"), (5, 4, "A", "B", None), (7, 5, "X", "lost", None), (7, 6, "A", None, "set")]
    return patches.update_rows(rows, t.spark.createDataFrame(fixes, "o_orderkey long, ordinal int, current string, name string, place string"), ["o_orderkey"], {"o_orderstatus": "name", "o_orderpriority": "place"}, match={"o_orderstatus": "current"})


@register("""SELECT o_orderkey AS id, o_custkey AS athlete, CAST(CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7) THEN 2 WHEN o_custkey = 7 THEN 999 ELSE o_orderkey % 9 END AS INTEGER) AS place,
CAST(CASE WHEN o_custkey = 7 AND o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7) THEN 1 ELSE 0 END AS INTEGER) AS is_dq FROM orders
UNION ALL SELECT 0, -1, 4, 0""")
def upsert_places(t: Tables) -> DataFrame:
    """The sentinel of athlete 7 becomes 2, athlete 8 stays where it is, and a new one is inserted once of two patches."""
    own = F.col("o_custkey") == 7
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("athlete"), F.when(own, 999).otherwise(F.col("o_orderkey") % 9).cast("int").alias("place"), own.cast("int").alias("is_dq"), F.lit(None).cast("int").alias("leg_idx"))
    fixes = [(7, 1, 2, "a", False, None), (7, 2, 3, "a", False, None), (8, 3, 5, "b", False, None), (-1, 4, 4, "c", False, None), (-1, 5, 6, "c", False, None), (-2, 6, 1, "skip", False, None), (-3, 7, 1, None, False, None)]
    fixes = t.spark.createDataFrame(fixes, "athlete long, ordinal int, place int, name string, is_relay boolean, leg_idx int")
    return patches.upsert_places(rows, fixes, ["athlete"], "id", "place", "name", ["is_dq"]).select(F.coalesce("id", F.lit(0)).alias("id"), "athlete", "place", "is_dq")


@register("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, l_returnflag AS name FROM lineitem WHERE l_orderkey NOT IN (1, 2) UNION ALL SELECT * FROM (VALUES (1, 1, 'Ann'), (1, 2, 'Unknown'), (2, 1, 'Bea'))""")
def replace_relay(t: Tables) -> DataFrame:
    """Teams 1 and 2 are replaced, one member of which isn't known; team 3 stays, as one of its members has no name yet."""
    members = t.spark.createDataFrame([(1, 1, "Ann"), (1, 2, "skip"), (2, 1, "Bea"), (3, 1, "Cid"), (3, 2, None)], "l_orderkey long, l_linenumber int, name string")
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_returnflag").alias("name"))
    return patches.replace_groups(rows, members, ["l_orderkey"], "name")


@register("SELECT c_custkey, CASE WHEN c_custkey = 3 THEN NULL WHEN c_custkey = 2 THEN 'Second' ELSE c_name END AS c_name, CASE WHEN c_custkey = 2 THEN 12.5 WHEN c_custkey = 4 THEN 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def dynamic_corrections(t: Tables) -> DataFrame:
    """Two corrections of one key, the second of which is for the name that the first has set; one for a name that isn't there."""
    fixes = [(2, {"c_name": "First"}, 1, None), (2, {"c_acctbal": "12.5", "c_name": "Second"}, 2, "First"), (3, {"c_name": None}, 3, None), (4, {"c_acctbal": "1"}, 4, None), (4, {"c_acctbal": "2"}, 5, "nobody")]
    fixes = t.spark.createDataFrame(fixes, "c_custkey long, corrections map<string,string>, ordinal int, c_name string")
    return patches.correct(t.customer.select("c_custkey", "c_name", "c_acctbal"), fixes, ["c_custkey"], ["c_name"])


@register("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT ((l_orderkey = 1 AND l_linenumber <> 1) OR l_orderkey = 3)")
def near_duplicate_places(t: Tables) -> DataFrame:
    cases = t.spark.createDataFrame([(1, "1"), (2, "both"), (3, "neither"), (4, None)], "l_orderkey long, keep string")
    return patches.keep_places(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), cases, ["l_orderkey"], "l_linenumber")


@register("SELECT 'deleted' AS action, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'updated', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'kept', count(*) FROM orders WHERE o_orderstatus = 'O'")
def patch_audit(t: Tables) -> DataFrame:
    before = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.filter("o_orderstatus <> 'P'").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return patches.audit(before, after, ["o_orderkey"])


@register("""SELECT a, b, CASE WHEN kind = 'exact' AND same_type AND gap = 0 THEN 'same_high' WHEN gap > 8 THEN CASE WHEN combines AND kind = 'fuzzy' THEN 'different_likely' ELSE 'different' END WHEN NOT combines THEN CASE WHEN kind = 'fuzzy' THEN 'different_likely' ELSE 'different' END ELSE 'same' END AS recommendation
FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, CASE (a.p_partkey + b.p_partkey) % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' ELSE 'initials' END AS kind, a.p_type = b.p_type AS same_type, abs(a.p_size - b.p_size) AS gap, (a.p_size + b.p_size) % 4 <> 0 AS combines
FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)""")
def decision_table(t: Tables) -> DataFrame:
    pairs = entity.blocked_pairs(t.part.select("p_name", "p_brand", "p_partkey", "p_size", "p_type"), "p_partkey", ["p_name", "p_brand"])
    a, b = F.col("a_p_partkey"), F.col("b_p_partkey")
    kind = F.when((a + b) % 3 == 0, "exact").when((a + b) % 3 == 1, "fuzzy").otherwise("initials")
    verdict = entity.recommend(kind, F.col("a_p_type") == F.col("b_p_type"), F.abs(F.col("a_p_size") - F.col("b_p_size")), (F.col("a_p_size") + F.col("b_p_size")) % 4 != 0)
    return pairs.select(a.alias("a"), b.alias("b"), verdict.alias("recommendation"))


@register("""WITH p AS (SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS given, lower(split_part(p_name, ' ', -1)) AS last, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'women' ELSE 'men' END AS gender, p_brand AS school, p_size AS first_year, p_size + p_partkey % 3 AS last_year FROM part ),
pairs AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.name = b.name AND a.school <> b.school THEN 1 WHEN a.last = b.last AND a.name <> b.name AND length(a.given) > 2 AND length(b.given) > 2 AND levenshtein(a.given, b.given) <= 1 THEN 3
  WHEN a.last <> b.last AND a.given = b.given AND length(a.last) > 2 AND length(b.last) > 2 AND levenshtein(a.last, b.last) <= 1 THEN 4
  WHEN a.gender = 'women' AND a.school = b.school AND a.given = b.given AND a.name <> b.name AND greatest(b.first_year - a.last_year, a.first_year - b.last_year, 0) <= 8 THEN 5 END AS k,
  greatest(b.first_year - a.last_year, a.first_year - b.last_year, 0) AS gap, a.school = b.school AS same_school FROM p a JOIN p b ON a.gender = b.gender AND a.id < b.id)
SELECT a, b, CASE k WHEN 1 THEN 'exact' WHEN 3 THEN 'fuzzy' WHEN 4 THEN 'cross_fuzzy' ELSE 'maiden_married' END AS strategy, CAST(gap AS INTEGER) AS gap, same_school,
CASE WHEN k = 1 AND same_school AND gap = 0 THEN 'same_high' WHEN gap > 8 THEN CASE WHEN k IN (3, 4) THEN 'different_likely' ELSE 'different' END ELSE 'same' END AS recommendation FROM pairs WHERE k IS NOT NULL""")
def candidate_strategies(t: Tables) -> DataFrame:
    """Parts as profiles: their names, brands as schools, sizes as years."""
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("id"), F.col("p_name").alias("name"), F.when(k % 2 == 0, "women").otherwise("men").alias("gender"), F.col("p_brand").alias("school"), F.col("p_size").alias("first_year"), (F.col("p_size") + k % 3).alias("last_year"), F.array().cast("array<string>").alias("groups"))
    return entity.candidates(rows).select("a", "b", "strategy", F.col("gap").cast("int").alias("gap"), "same_school", "recommendation")


def part_edges(t: Tables) -> DataFrame:
    return entity.linking_edges(t.part, "p_partkey", ["p_name", "p_brand"], "p_size", 5)


EDGES_SQL = """edges AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND abs(a.p_size - b.p_size) <= 5),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)"""


@register(f"WITH RECURSIVE {EDGES_SQL} SELECT node, root FROM roots")
def components(t: Tables) -> DataFrame:
    return entity.components(part_edges(t))


@register(f"""WITH RECURSIVE {EDGES_SQL}, known AS (SELECT p_partkey AS node, 20000 + p_partkey AS id FROM part WHERE p_partkey % 3 = 0),
hits AS (SELECT root, count(DISTINCT id) AS n, min(id) AS id FROM roots LEFT JOIN known USING (node) GROUP BY 1)
SELECT root, CAST(CASE WHEN n = 0 THEN (SELECT max(id) FROM known) + row_number() OVER (PARTITION BY n = 0 ORDER BY root) WHEN n = 1 THEN id END AS BIGINT) AS id, CASE WHEN n = 0 THEN 'new' WHEN n = 1 THEN 'reused' ELSE 'merged' END AS status FROM hits""")
def stable_ids(t: Tables) -> DataFrame:
    known = t.part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") + 20000).alias("id"))
    return entity.stable_ids(entity.components(part_edges(t)), known)


@register(f"WITH RECURSIVE {EDGES_SQL} SELECT x.node AS a, y.node AS b, x.root FROM roots x JOIN roots y ON y.node = x.node + 1 AND x.root = y.root")
def contradictions(t: Tables) -> DataFrame:
    different = t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"))
    return entity.contradictions(entity.components(part_edges(t)), different)


@register("SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders WHERE o_totalprice > 400000 OR o_orderkey % 9 = 0 GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def unambiguous_match(t: Tables) -> DataFrame:
    return entity.unambiguous(t.orders.filter("o_totalprice > 400000 OR o_orderkey % 9 = 0"), "o_custkey", "o_orderpriority")


@register("""SELECT rule, CAST(c_custkey AS VARCHAR) AS key, c_name AS detail FROM (SELECT 'single_word' AS rule, * FROM customer WHERE c_name NOT LIKE '% %' UNION ALL SELECT 'odd_characters', * FROM customer WHERE regexp_matches(c_name, '[0-9:?*]|—|--') UNION ALL SELECT 'long', * FROM customer WHERE length(c_name) > 50
UNION ALL SELECT 'parentheses', * FROM customer WHERE c_name LIKE '%(%' OR c_name LIKE '%)%' UNION ALL SELECT 'empty', * FROM customer WHERE c_name IS NULL OR trim(c_name) = '')""")
def suspicious_text(t: Tables) -> DataFrame:
    return quality.name_issues(t.customer, "c_custkey", "c_name")


@register("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1995 AND 1998)")
def coverage_gaps(t: Tables) -> DataFrame:
    coverage = t.spark.createDataFrame([("F", y) for y in range(1995, 1999)], "o_orderstatus string, year int")
    return quality.uncovered(t.orders.withColumn("year", F.year("o_orderdate")), coverage, ["year", "o_orderstatus"])


@register("""SELECT 'duplicates' AS rule, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'orphans', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def quality_summary(t: Tables) -> DataFrame:
    return quality.summary([("duplicates", exact_duplicates(t)), ("orphans", orphan_check(t))])


@register("""WITH marked AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 6 HOUR OR ts = lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts))) AS BIGINT) + 21600 AS end_s, count(*) AS n FROM numbered GROUP BY user_id, s""")
def event_sessions(t: Tables) -> DataFrame:
    found = sessions.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "6 hours", "1 hour")
    return found.select("user_id", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "n")
