"""Queries over the results table itself: search, corrections, imports, coverage and marks, bound to orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import marks
from tallyloom.operators import patches, quality, search
from tallyloom.plans.registry import Tables, register

RESULTS = [
    "o_orderkey AS id", "year(o_orderdate) AS year", "concat('Ann ', translate(CAST(o_custkey AS STRING), '0123456789', 'abcdefghij')) AS name", "o_orderpriority AS school", "o_clerk AS discipline", "CASE WHEN o_custkey % 2 = 0 THEN 'men' ELSE 'women' END AS gender",
    "CAST(o_orderkey % 12 AS INT) AS place", "CAST(o_totalprice AS DOUBLE) AS mark_num", "o_orderkey % 5 = 0 AS is_dq", "o_orderkey % 7 = 0 AS is_dnf", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 END AS is_relay", "CASE WHEN o_custkey % 3 = 0 THEN 'indoor' ELSE 'outdoor' END AS environment",
]
RESULTS_SQL = """WITH r AS (
  SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year, 'Ann ' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS name, o_orderpriority AS school, CASE WHEN o_custkey % 2 = 0 THEN 'men' ELSE 'women' END AS gender,
    CAST(o_orderkey % 12 AS INTEGER) AS place, CAST(o_totalprice AS DOUBLE) AS mark_num, o_orderkey % 5 = 0 AS is_dq, o_orderkey % 7 = 0 AS is_dnf, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 END AS is_relay, CASE WHEN o_custkey % 3 = 0 THEN 'indoor' ELSE 'outdoor' END AS environment FROM orders) """
WANTED = search.Search(query="URG", name="a_n", school="-", year_min=1993, year_max=1997, gender="MEN", place_max=9, is_dq=False, is_relay=False, environment="Outdoor", order_by="mark_num", descending=True, limit=50, offset=5)
WANTED_SQL = "(name ILIKE '%URG%' OR school ILIKE '%URG%') AND name ILIKE '%a_n%' AND school ILIKE '%-%' AND year BETWEEN 1993 AND 1997 AND gender = 'men' AND place <= 9 AND NOT is_dq AND NOT coalesce(is_relay, false) AND environment = 'outdoor'"


def results(t: Tables) -> DataFrame:
    have = {"o_clerk"} & set(t.orders.columns)
    return t.orders.selectExpr(*[e if have or "o_clerk" not in e else "'x' AS discipline" for e in RESULTS])


@register(RESULTS_SQL + f"SELECT id, year, name, school, place, mark_num FROM r WHERE {WANTED_SQL} ORDER BY mark_num DESC NULLS LAST, id LIMIT 50 OFFSET 5")
def search_results(t: Tables) -> DataFrame:
    return search.search(results(t), WANTED, "id").select("id", "year", "name", "school", "place", "mark_num")


@register(RESULTS_SQL + f"SELECT count(*) AS n FROM r WHERE {WANTED_SQL}")
def search_count(t: Tables) -> DataFrame:
    return search.count(results(t), WANTED)


@register(RESULTS_SQL + "SELECT gender || ' ' || year || ': ' || name || ' | place: ' || place || CASE WHEN is_dq THEN ' | status: DQ' ELSE '' END AS line FROM r")
def printed_records(t: Tables) -> DataFrame:
    r = results(t)
    head = F.concat_ws(" ", "gender", F.concat(F.col("year").cast("string"), F.lit(":")), "name")
    rest = search.one_line({"place": F.col("place"), "status": F.when(F.col("is_dq"), F.lit("DQ"))})
    return r.select(F.concat_ws(" | ", head, rest).alias("line"))


@register("""
WITH r AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS note FROM orders)
SELECT id, CAST(CASE k % 10 WHEN 1 THEN k + 1000000 ELSE k END AS BIGINT) AS k, CASE WHEN k % 10 = 3 THEN NULL WHEN k % 10 = 4 AND year = 1995 THEN 1900 ELSE year END AS year,
  CASE k % 10 WHEN 1 THEN 'moved' WHEN 2 THEN 'late' WHEN 4 THEN CASE WHEN year = 1995 THEN 'was 1995' ELSE note END ELSE note END AS note FROM r""")
def key_corrections(t: Tables) -> DataFrame:
    """Corrections of the key itself, of which later patches see the new one only, and of optional columns."""
    rows = t.orders.selectExpr("o_orderkey AS id", "o_custkey AS k", "year(o_orderdate) AS year", "o_orderpriority AS note")
    c = t.customer.select("c_custkey")
    none = "CAST(NULL AS INT) AS year"
    one = lambda digit, ordinal, key, year, pairs: c.filter(f"c_custkey % 10 = {digit}").selectExpr(f"{ordinal} AS ordinal", f"{key} AS k", year, f"map({pairs}) AS corrections")
    p = one(1, 1, "c_custkey", none, "'k', CAST(c_custkey + 1000000 AS STRING)").unionByName(one(1, 2, "c_custkey", none, "'note', 'of the old key'")).unionByName(one(1, 3, "c_custkey + 1000000", none, "'note', 'moved'"))
    p = p.unionByName(one(2, 1, "c_custkey", none, "'note', 'early'")).unionByName(one(2, 2, "c_custkey", none, "'note', 'late'")).unionByName(one(3, 1, "c_custkey", none, "'year', CAST(NULL AS STRING)"))
    p = p.unionByName(one(4, 1, "c_custkey", "1995 AS year", "'note', 'was 1995', 'year', '1900'")).unionByName(one(4, 2, "c_custkey", "1995 AS year", "'note', 'nobody'"))
    return patches.correct(rows, p, ["k"], optional=["year"])


@register("""
WITH d AS (SELECT DISTINCT l_orderkey AS team, 'S' AS school, CAST(l_linenumber AS INTEGER) AS leg, CASE WHEN l_linenumber % 2 = 0 THEN 'Relay member unknown' ELSE 'Old' || l_linenumber END AS name FROM lineitem),
e AS (SELECT DISTINCT o_orderkey AS team, 'S' AS school, leg, CASE WHEN (o_orderkey + leg) % 3 = 0 THEN 'New' || leg END AS name FROM orders, (VALUES (2), (4), (9)) AS l(leg))
SELECT d.* FROM d ANTI JOIN (SELECT * FROM e WHERE name IS NOT NULL) n ON d.team = n.team AND d.leg = n.leg AND d.name = 'Relay member unknown'
UNION ALL SELECT team, school, leg, name FROM e WHERE name IS NOT NULL
UNION ALL SELECT team, school, leg, 'Relay member unknown' FROM e WHERE name IS NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.team = e.team AND d.leg = e.leg AND d.name = 'Relay member unknown')""")
def imported_entries(t: Tables) -> DataFrame:
    """Legs 2, 4 and 9 of every team by hand: named ones take an unknown member's place, nameless ones fill a hole."""
    have = t.lineitem.selectExpr("l_orderkey AS team", "'S' AS school", "0 AS place", "CAST(l_linenumber AS INT) AS leg_idx", "CASE WHEN l_linenumber % 2 = 0 THEN 'Relay member unknown' ELSE concat('Old', l_linenumber) END AS name", "true AS is_relay").distinct()
    entries = t.orders.select("o_orderkey", F.explode(F.array(*map(F.lit, (2, 4, 9)))).alias("leg")).selectExpr("o_orderkey AS team", "'S' AS school", "0 AS place", "leg AS leg_idx", "CASE WHEN (o_orderkey + leg) % 3 = 0 THEN concat('New', leg) END AS name", "true AS is_relay", "leg AS ordinal", "false AS skip")
    skipped = entries.selectExpr("team", "school", "place", "99 AS leg_idx", "'Skipped' AS name", "is_relay", "0 AS ordinal", "true AS skip")
    out = patches.import_entries(have, entries.unionByName(skipped), ["team"])
    return out.select("team", "school", F.col("leg_idx").alias("leg"), "name")


@register("""
WITH have AS (SELECT DISTINCT o_orderpriority AS p, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders WHERE o_orderkey % 40 < 39 AND NOT (year(o_orderdate) = 1995 AND o_orderpriority LIKE '1%')),
promised AS (SELECT p, CAST(y AS INTEGER) AS y FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderpriority NOT LIKE '5%'), range(1990, 2002) AS r(y) WHERE y <> 1994),
lacking AS (SELECT p, y, y - row_number() OVER (PARTITION BY p ORDER BY y) AS g FROM (SELECT * FROM promised EXCEPT SELECT * FROM have) WHERE y NOT IN (1991) AND y < 2001)
SELECT 'fail' AS side, p AS priority, CAST(y AS VARCHAR) AS years FROM (SELECT * FROM have EXCEPT SELECT * FROM promised)
UNION ALL SELECT 'warn', p, CASE WHEN min(y) = max(y) THEN CAST(min(y) AS VARCHAR) ELSE min(y) || '-' || max(y) END FROM lacking GROUP BY p, g""")
def coverage_both_ways(t: Tables) -> DataFrame:
    rows = t.orders.selectExpr("o_orderkey", "o_orderpriority AS priority", "year(o_orderdate) AS year").filter("o_orderkey % 40 < 39 AND NOT (year = 1995 AND priority LIKE '1%')")
    keys = t.orders.filter("o_orderpriority NOT LIKE '5%'").select(F.col("o_orderpriority").alias("priority")).distinct()
    ranges = keys.selectExpr("priority", "explode(array(named_struct('s', 1990, 'e', 1993), named_struct('s', 1995, 'e', CAST(NULL AS INT)), named_struct('s', 1999, 'e', 2000))) AS r").selectExpr("priority", "r.s AS start", "r.e AS end")
    return quality.coverage(rows, ranges, ["priority"], "year", exclude=(1991,), before=2001)


MARKS_SQL = """WITH r AS (
  SELECT l_orderkey AS k, l_partkey % 2 = 0 AS field, l_linenumber AS place, l_quantity AS mark, l_partkey * 1000 + l_suppkey AS id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus FROM lineitem)
  WHERE l_returnflag <> 'R' AND NOT (l_linestatus = 'O' AND l_linenumber > 2)),
o AS (SELECT *, lag(place) OVER w AS previous_place, lag(mark) OVER w AS previous_mark FROM r WINDOW w AS (PARTITION BY k, field ORDER BY place, id, mark)) """


def marked(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus").distinct()
    return rows.selectExpr("l_orderkey AS k", "l_partkey % 2 = 0 AS field", "l_linenumber AS place", "CAST(l_quantity AS DOUBLE) AS mark", "struct(l_partkey * 1000 + l_suppkey AS a, l_quantity AS b) AS id", "l_returnflag = 'R' AS is_dq", "false AS is_dnf", "CAST(NULL AS BOOLEAN) AS is_dns", "l_linestatus = 'O' AS is_relay", "CASE WHEN l_linenumber > 2 THEN 1 END AS leg_idx")


@register(MARKS_SQL + "SELECT k, field, CAST(previous_place AS INTEGER) AS previous_place, CAST(previous_mark AS DOUBLE) AS previous_mark, CAST(place AS INTEGER) AS place, CAST(mark AS DOUBLE) AS mark FROM o WHERE CASE WHEN field THEN previous_mark < mark ELSE previous_mark > mark END")
def mark_ordering(t: Tables) -> DataFrame:
    """Even parts are field events, whose quantity falls with the line number; returned lines and late open ones stay out."""
    out = quality.mark_order(marked(t), ["k", "field"], "place", "mark", "id", F.col("field"))
    return out.select("k", "field", F.col("previous_place").cast("int").alias("previous_place"), "previous_mark", F.col("place").cast("int").alias("place"), "mark")


@register(MARKS_SQL + """, n AS (SELECT 'mark order' AS rule, count(*) AS n FROM o WHERE CASE WHEN field THEN previous_mark < mark ELSE previous_mark > mark END UNION ALL SELECT 'no name', count(*) FROM customer WHERE c_name IS NULL),
a AS (SELECT * FROM n UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM n) SELECT *, n > 0 AS failed FROM a""")
def quality_report(t: Tables) -> DataFrame:
    return quality.report([("mark order", quality.mark_order(marked(t), ["k", "field"], "place", "mark", "id", F.col("field"))), ("no name", t.customer.filter("c_name IS NULL"))])


@register(r"""
WITH p AS (SELECT p_partkey AS k, p_partkey % 60 AS s FROM part)
SELECT k, CASE k % 7 WHEN 0 THEN (k % 9) * 60 + (s + 0.5::DOUBLE) WHEN 1 THEN s::DOUBLE WHEN 2 THEN s::DOUBLE / 100 WHEN 3 THEN s * 0.3048::DOUBLE + 7.5::DOUBLE * 0.0254::DOUBLE WHEN 4 THEN s + 0.25::DOUBLE WHEN 5 THEN NULL END AS num, k % 7 IN (1, 4) AS altitude, k % 7 = 4 OR k % 7 = 0 AS converted,
  CASE k % 3 WHEN 0 THEN s + 0.5::DOUBLE WHEN 1 THEN 0 ELSE -s::DOUBLE END AS prefix FROM p""")
def missing_marks(t: Tables) -> DataFrame:
    p = t.part.selectExpr("p_partkey AS k", "p_partkey % 60 AS s")
    text = "CASE k % 7 WHEN 0 THEN concat(k % 9, ':', s, '.5c') WHEN 1 THEN concat(s, 'm (A)') WHEN 2 THEN concat(s, 'cm') WHEN 3 THEN concat(s, '-7.5') WHEN 4 THEN concat(' ', s, '.25+A') WHEN 5 THEN 'none' ELSE '?' END"
    loose = "CASE k % 3 WHEN 0 THEN concat(' ', s, '.5abc') WHEN 1 THEN 'abc1' ELSE concat('-', s, ' x 9') END"
    parsed = marks.parse_missing_mark(F.expr(text))
    return p.select("k", parsed["num"].alias("num"), parsed["altitude"].alias("altitude"), parsed["converted"].alias("converted"), marks.cast_prefix(F.expr(loose)).alias("prefix"))
