"""Queries over result pages: pages written from orders, and the joins that their dialects need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tables import CLASSES, EVENT_CODES
from tallyloom.operators import joins, page_results, windows
from tallyloom.operators.stages import kept
from tallyloom.plans.registry import Tables, register
from tallyloom.sources import pages

LISTED_SQL = """
WITH o AS (
  SELECT o_custkey AS c, o_orderkey AS k, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS w, lower(translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) AS low,
    CASE WHEN o_orderkey % 7 = 0 THEN 999 ELSE CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) END AS place FROM orders),
e AS (SELECT *, 1990 + c % 30 AS year FROM o JOIN (VALUES (0, 'outdoor', 'men', '60m', 'track'), (1, 'indoor', 'men', '4x400m Relay', 'relay'), (2, 'indoor', 'women', 'Shot Put', 'field'), (3, 'indoor', 'women', 'Pentathlon', 'multi'),
  (5, 'indoor', 'women', '4x800m Relay', 'relay')) AS v(kind_no, environment, gender, discipline, kind) ON c % 6 = kind_no),
rows AS (SELECT *, CASE kind WHEN 'track' THEN '10.' || (k % 90 + 10) WHEN 'relay' THEN '3:05.' || (k % 10) WHEN 'field' THEN '15.' || (k % 90 + 10) || 'm' ELSE CAST(5000 + k % 900 AS VARCHAR) END AS mark_str FROM e)
SELECT c, CAST(year AS INTEGER) AS year, 'Saturday, March 15' AS date, 'Town, ' || lower(translate(CAST(c AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) AS location, environment, gender, discipline,
  CASE WHEN kind <> 'relay' THEN 'Jordan Q' || low WHEN k % 3 = 0 THEN 'Relay member unknown' ELSE split_part('Ann,Bo,Cy,Di', ',', CAST(leg AS INTEGER)) || ' Q' || low END AS name, 'School ' || low AS school,
  CASE WHEN kind <> 'relay' THEN 'junior' WHEN k % 3 <> 0 AND leg = 2 THEN 'sophomore' END AS class, place, CASE kind WHEN 'relay' THEN 180 + CAST(split_part(mark_str, ':', 2) AS DOUBLE) ELSE CAST(replace(mark_str, 'm', '') AS DOUBLE) END AS mark_num,
  mark_str, place = 999 AS is_dq, CAST(CASE WHEN kind = 'relay' THEN leg END AS INTEGER) AS leg_idx, CASE WHEN kind = 'relay' AND k % 3 <> 0 AND leg > 1 THEN '4' || leg || '.' || (k % 10) END AS split_time
FROM rows, range(1, 5) AS l(leg) WHERE (kind = 'relay' OR leg = 1) AND NOT (discipline = '4x800m Relay' AND gender = 'women' AND year = 1994)
"""


@register(LISTED_SQL)
def listed_pages(t: Tables) -> DataFrame:
    """A page per customer: an outer table with the header, a list of results in it, members in a row of their own."""
    o = t.orders.selectExpr("o_custkey AS c", "o_orderkey AS k", "translate(CAST(o_orderkey AS STRING), '0123456789', 'ABCDEFGHIJ') AS w", "CASE WHEN o_orderkey % 7 = 0 THEN 999 ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS p")
    mark = "CASE c % 6 WHEN 0 THEN concat('10.', k % 90 + 10) WHEN 2 THEN concat('15.', k % 90 + 10, 'm') WHEN 3 THEN concat('5,', substr(CAST(5000 + k % 900 AS STRING), 2)) ELSE concat('3:05.', k % 10) END"
    single = f"concat('<tr><td>(', p, ') <a href=\"#\">Jordan Q', w, '</a>JR</td><td>x</td><td> School ', lower(w), ' </td><td>', {mark}, '</td></tr>')"
    members = "concat('Ann Q', w, ', Bo Q', w, ' (SO) 42.', k % 10, ', Cy Q', w, ' 43.', k % 10, ', Di Q', w, ' 44.', k % 10)"
    team = f"concat('<tr><td>(', p, ') School ', lower(w), '</td><td></td><td></td><td>', {mark}, '</td></tr>', CASE WHEN k % 3 = 0 THEN '' ELSE concat('<tr><td colspan=4>', {members}, '</td></tr>') END)"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr(f"CASE WHEN c % 6 IN (1, 5) THEN {team} ELSE {single} END").alias("row")))), lambda x: x["row"]), "")
    made = o.groupBy("c").agg(body.alias("rows")).withColumn("file_name", F.expr("element_at(array('outdoor_men_1.html', 'men_19.html', 'women_25.html', 'women_30.html', 'women_99.html', 'women_63.html'), CAST(c % 6 AS INT) + 1)"))
    html = F.expr("concat('<html><table><tr><td colspan=\"2\">', 1990 + c % 30, ' * Town, ', translate(CAST(c AS STRING), '0123456789', 'abcdefghij'), ' * Saturday, March 15</td></tr><tr><td><table><tr><th>Pl</th></tr>', rows, '</table></td></tr></table></html>')")
    skip = (F.col("code") == "63") & (F.col("gender") == "women") & (F.col("year") == 1994)
    found = page_results.listed_results(made.withColumn("html", html), pages.file_facts(F.col("file_name")), "html", EVENT_CODES, CLASSES, {}, least_length=100, skip=skip)
    # The page's customer is told by its town again.
    c = F.translate(F.regexp_extract("location", "([a-j]+)$", 1), "abcdefghij", "0123456789").cast("long")
    return found.select(c.alias("c"), "year", "date", "location", "environment", "gender", "discipline", "name", "school", "class", "place", "mark_num", "mark_str", "is_dq", "leg_idx", "split_time")


#: Entries of a compiled page.
ENTRIES = 500
TABLED_SQL = """
WITH o AS (SELECT o_custkey % 5 AS e, o_orderkey AS k, lower(translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ')) AS w, CAST(row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) AS INTEGER) AS place FROM orders),
m AS (SELECT *, CASE WHEN e < 2 THEN '3:05.' || (k % 10) WHEN e = 2 THEN '10.' || (k % 90 + 10) WHEN e = 3 THEN '15.' || (k % 90 + 10) || 'm' ELSE CAST(5000 + k % 900 AS VARCHAR) END AS mark_str FROM o)
SELECT split_part('4x400m,DMR,60m,Shot Put,Heptathlon', ',', CAST(e AS INTEGER) + 1) AS discipline, CASE WHEN e > 1 THEN 'Jo Q' || w WHEN k % 7 = 0 THEN 'Relay member unknown' ELSE split_part('Ann,Bo,Cy,Di', ',', CAST(leg AS INTEGER)) || ' Q' || w END AS name,
  'School ' || w AS school, CASE WHEN e > 1 THEN 'senior' END AS class, place, CASE WHEN e < 2 THEN 180 + CAST(split_part(mark_str, ':', 2) AS DOUBLE) ELSE CAST(replace(mark_str, 'm', '') AS DOUBLE) END AS mark_num, mark_str,
  CAST(CASE WHEN e < 2 THEN leg END AS INTEGER) AS leg_idx, CASE WHEN e < 2 AND k % 4 <> 0 AND leg <= k % 6 THEN '4' || leg || '.' || (k % 10) END AS split_time, 'Friday, March 13' AS date
FROM m, range(1, 5) AS l(leg) WHERE e < 2 OR leg = 1
"""


@register(TABLED_SQL)
def tabled_pages(t: Tables) -> DataFrame:
    """Compiled pages of five events, ENTRIES to a page, of which those of relays link to three pages with split times and
    athletes of their teams. Places count through all pages of an event."""
    o = t.orders.selectExpr("CAST(o_custkey % 5 AS INT) AS e", "o_orderkey AS k", "translate(CAST(o_orderkey AS STRING), '0123456789', 'ABCDEFGHIJ') AS w")
    o = windows.numbered(o, ["e", "k"])
    o = o.join(F.broadcast(o.groupBy("e").agg(F.min("row_id").alias("first"))), "e").withColumn("p", F.col("row_id") - F.col("first") + 1)
    o = o.withColumn("code", F.expr(f"concat('00', e, '_', (p - 1) DIV {ENTRIES})"))
    mark = "CASE WHEN e < 2 THEN concat('3:05.', k % 10, ' q') WHEN e = 2 THEN concat('10.', k % 90 + 10, ' PB') WHEN e = 3 THEN concat('15.', k % 90 + 10, 'm') ELSE concat(5000 + k % 900, 'pts') END"
    who = "CASE WHEN e < 2 THEN concat('<b>Team</b><small>School ', lower(w), '</small>') ELSE concat('<a class=\"openStats\" href=\"x\">Jo Q', w, '</a><br><small>School&nbsp;', lower(w), ' [SR]</small>') END"
    entry = f"concat('<tr><td>', p, '</td><td>1</td><td>', {who}, '</td><td>', {mark}, '</td></tr>')"
    ordered = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr(x).alias("row")))), lambda y: y["row"]), "")
    head = "'<table id=\"headerevent\"><tr><td>Final</td></tr><tr><td>Friday 6 pm</td></tr></table>'"
    table_id = "CASE WHEN e = 4 THEN 'multitotalscores' ELSE 'events' END"
    links = "CASE WHEN e < 2 THEN concat('<a href=\"', code, '-1.htm\">1</a><a href=\"', code, '-2.htm\">2</a><a href=\"', code, '-3.htm\">3</a><a href=\"', code, '-3.htm\">3</a><a href=\"009-1.htm\">no</a>') ELSE '' END"
    compiled = o.groupBy("e", "code").agg(ordered(entry).alias("rows")).selectExpr("concat(code, '_compiled.htm') AS file_name", f"concat({head}, {links}, '<table id=\"', {table_id}, '\"><thead><tr><th>Pl</th></tr></thead><tbody>', rows, '</tbody></table>') AS html")
    cell = lambda n: f"CASE WHEN k % 6 >= {n} THEN concat('<td>{n}:0{n}.0 [4{n}.', k % 10, ']</td>') ELSE '<td></td>' END"
    times = f"CASE WHEN k % 4 = 0 THEN '' ELSE concat('<tr><td>', p, '</td><td>1</td><td></td><td><small>School ', lower(w), '</small></td><td>x</td>', {', '.join(map(cell, range(1, 5)))}, '</tr>') END"
    people = "CASE WHEN k % 7 = 0 THEN '' ELSE concat('<tr><td>School ', lower(w), '</td><td>Ann Q', w, ', Bo Q', w, ', Cy Q', w, ', Di Q', w, '</td></tr>') END"
    sections = o.filter("e < 2").withColumn("n", F.expr("k % 3 + 1")).groupBy("code", "n").agg(ordered(times).alias("times"), ordered(people).alias("people"))
    sections = sections.selectExpr("concat(code, '-', n, '.htm') AS file_name", "concat('<table id=\"splits\"><tbody>', times, '</tbody></table><table><thead class=\"thead-dark\"><tr><th>Team</th><th>Athletes</th></tr></thead><tbody>', people, '</tbody></table>') AS html")
    names, kinds = "array('4x400m', 'DMR', '60m', 'Shot Put', 'Heptathlon')[e]", "array('relay', 'relay', 'track', 'field', 'multi')[e]"
    events = o.select("e", "code").distinct().selectExpr("concat(code, '_compiled.htm') AS file_name", "code", f"{names} AS discipline", "'men' AS gender", f"{kinds} AS kind")
    found = page_results.tabled_results(compiled.unionByName(sections), kept(events), 2026, "Fayetteville, AR", "indoor", {"Friday": "Friday, March 13", "Saturday": "Saturday, March 14"}, CLASSES, {}, most_place=1 << 30)
    return found.select("discipline", "name", "school", "class", "place", "mark_num", "mark_str", "leg_idx", "split_time", "date")


@register("""
WITH items AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_linenumber) FILTER (l_returnflag <> 'R') AS items FROM lineitem GROUP BY 1),
vals AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_suppkey) AS vals FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 10 GROUP BY 1),
i AS (SELECT l_orderkey, CASE WHEN len(items) > 0 THEN items ELSE [NULL, NULL, NULL, NULL] END AS items FROM items)
SELECT l_orderkey, CAST(p AS INTEGER) AS position, items[p] AS partkey, vals[p] AS suppkey FROM (SELECT *, unnest(range(1, len(items) + 1)) AS p FROM i) LEFT JOIN vals USING (l_orderkey)""")
def split_zip(t: Tables) -> DataFrame:
    """The parts of each order beside its suppliers by position: lists of unequal length, either of which may lack."""
    parts = F.expr("transform(array_sort(collect_list(CASE WHEN l_returnflag <> 'R' THEN struct(l_partkey, l_linenumber) END)), x -> x.l_partkey)")
    items = t.lineitem.groupBy("l_orderkey").agg(parts.alias("items"))
    values = t.lineitem.filter("l_linestatus = 'O' AND l_quantity > 10").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("values"))
    return joins.zipped(items, values, ["l_orderkey"], "items", "values", "partkey", "suppkey", 4)


@register("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AND lead(o_orderstatus) OVER w <> 'F' AS takes, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, CASE WHEN takes THEN next END AS taken FROM o WHERE NOT EXISTS (SELECT 1 FROM o AS p WHERE p.takes AND p.next = o.o_orderkey)""")
def lookahead_members(t: Tables) -> DataFrame:
    """A finished order takes the customer's next one if that isn't finished, which then stands for nothing itself."""
    value = F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))
    return windows.with_next_row(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"], F.col("o_orderstatus") == "F", value, "taken").drop("o_orderstatus")
