"""Queries over text documents: documents written from orders, and the grammars of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import lines
from tallyloom.functions.tables import CLASSES
from tallyloom.operators import documents, joins, windows
from tallyloom.operators.stages import spread
from tallyloom.plans.registry import Tables, register
from tallyloom.sources import readers

LETTERS = "translate(CAST(o_orderkey AS STRING), '0123456789', 'abcdefghij')"

RELAY_DOCUMENTS_SQL = """
WITH o AS (
  SELECT o_custkey AS doc, o_orderkey AS k, CAST(year(o_orderdate) AS INTEGER) AS year, translate(CAST(o_orderkey AS VARCHAR), '0123456789', 'abcdefghij') AS w,
    CAST(row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS INTEGER) AS place FROM orders),
m AS (SELECT *, lpad(CAST(k % 60 AS VARCHAR), 2, '0') || '.' || (k % 10) AS s, k % 6 AS kind FROM o),
legs AS (SELECT * FROM m, (VALUES (1, 'Ann'), (2, 'Bo'), (3, 'Cy'), (4, 'Di')) AS l(leg, first) WHERE kind <> 4)
SELECT doc, year, place, CASE WHEN kind = 2 THEN 'Relay member unknown' ELSE first || ' ' || w END AS name, 'Team ' || w AS school, 180 + CAST(s AS DOUBLE) AS mark_num, '3:' || s AS mark_str, leg AS leg_idx,
  CASE WHEN kind = 1 THEN (49 - leg) || '.' || (k % 10) END AS split_time, 'Town ' || translate(CAST(doc AS VARCHAR), '0123456789', 'abcdefghij') AS location, 'June ' || (1 + year % 28) AS date, kind = 3 AS is_dq, false AS is_dnf FROM legs
UNION ALL SELECT doc, year, NULL, 'Runner ' || w, 'Team ' || w, NULL, NULL, NULL, NULL, 'Town ' || translate(CAST(doc AS VARCHAR), '0123456789', 'abcdefghij'), 'June ' || (1 + year % 28), false, true FROM m WHERE kind = 4
"""


@register(RELAY_DOCUMENTS_SQL)
def relay_documents(t: Tables) -> DataFrame:
    """A document per customer, a section per year, a team per order: members in one line or continued in the next, with
    times or without, missing ones, and statuses that count for the next entry or that a blank line ends."""
    o = t.orders.selectExpr("o_custkey AS doc", "o_orderkey AS k", "year(o_orderdate) AS year", f"{LETTERS} AS w", "row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS p")
    mark = "concat('3:', lpad(CAST(k % 60 AS STRING), 2, '0'), '.', k % 10)"
    team, four = f"concat(p, '. Team ', w, ' ..... ', {mark})", "concat('(Ann ', w, ', Bo ', w, ', Cy ', w, ', Di ', w, ')')"
    entry = f"""CASE k % 6
      WHEN 0 THEN array({team}, {four})
      WHEN 1 THEN array({team}, concat('   (Ann ', w, ' 48.', k % 10, ', Bo ', w, ' 47.', k % 10, ','), concat('    Cy ', w, ' 46.', k % 10, ', Di ', w, ' 45.', k % 10, ')'))
      WHEN 2 THEN array({team}, '')
      WHEN 3 THEN array('... DQ', concat('[', p, ']Team ', w, ' ..... [', {mark}, ']'), {four})
      WHEN 4 THEN array('... DNF', concat('Runner ', w, ' (Team ', w, ')'))
      ELSE array('... DNS', '', {team}, {four}) END"""
    head = "array(CAST(year AS STRING), concat('(Town ', translate(CAST(doc AS STRING), '0123456789', 'abcdefghij'), ', June ', 1 + year % 28, ')'))"
    years = o.groupBy("doc", "year").agg(F.expr(f"concat({head}, flatten(transform(array_sort(collect_list(struct(k, {entry} AS entry))), x -> x.entry)))").alias("lines"))
    texts = years.groupBy("doc").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("year", "lines"))), lambda x: x["lines"])), "\n").alias("text"))
    found = documents.results(readers.lines(texts, "doc", "text"), "doc", "line_no", "line", F.lit(True), CLASSES, {})
    return found.select("doc", "year", "place", "name", "school", "mark_num", "mark_str", "leg_idx", "split_time", "location", "date", "is_dq", "is_dnf")


@register("""
WITH listing AS (SELECT l_orderkey, l_suppkey, max(l_linenumber) AS place FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, l_partkey, CAST(l.place AS INTEGER) AS place, coalesce(CAST(l.place AS DOUBLE) / 2, l_quantity) AS mark FROM lineitem LEFT JOIN listing l USING (l_orderkey, l_suppkey)
WHERE l_returnflag = 'R'""")
def composite_inherit(t: Tables) -> DataFrame:
    """Returned lines take place and mark of the order's other lines of their supplier; without one they lose the place."""
    listing = t.lineitem.filter("l_returnflag <> 'R'").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_linenumber").cast("int").alias("place")).withColumn("mark", F.col("place").cast("double") / 2)
    rows = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", "l_suppkey", "l_partkey", F.col("l_linenumber").cast("int").alias("place"), F.col("l_quantity").cast("double").alias("mark"))
    return joins.inherited(rows, listing, ["l_orderkey", "l_suppkey"], ["place", "mark"], blank=["place"])


@register("SELECT o_orderkey, CAST(leg AS INTEGER) AS leg FROM orders LEFT JOIN (SELECT unnest(range(1, 5)) AS leg) ON o_orderstatus = 'F'")
def leg_padding(t: Tables) -> DataFrame:
    return windows.padded(t.orders.select("o_orderkey", "o_orderstatus"), F.when(F.col("o_orderstatus") == "F", F.lit(4)).otherwise(F.lit(0)), "leg").select("o_orderkey", "leg")


@register(r"""
WITH c AS (SELECT c_custkey AS k, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS w FROM customer)
SELECT k, CAST(leg AS INTEGER) AS leg, replace(name, '#', w) AS name, split_time, foreign_mark FROM c JOIN (VALUES
  (0, 1, 'José #', '48.3', false), (0, 2, 'Núñez #', '1:47.1', false), (1, 1, 'Ann #', '48.31', false), (1, 2, 'Bo #', '47.2', false),
  (2, 1, 'Ann # X', '48.3', false), (2, 2, 'Bo #', '47.1', false), (2, 3, 'Cy #', '46.5', false), (2, 4, 'Di #', '45.0', false),
  (3, 1, 'Ann #', NULL, false), (3, 3, 'Cy #', NULL, false), (4, 1, 'Ann #', '53.65', false), (4, 2, 'Bo #', '51.25', false), (5, 1, 'Ann #', NULL, true), (5, 2, 'Bo #', NULL, false), (5, 3, 'Cy', NULL, false),
  (5, 4, 'Di #', NULL, false)) AS v(kind, leg, name, split_time, foreign_mark) ON k % 6 = kind""")
def team_members_lines(t: Tables) -> DataFrame:
    """Accents, glued and converted times, a part that belongs to the next, parts that are none, quotes between names."""
    c = spread(t.customer.select("c_custkey"), "c_custkey").selectExpr("c_custkey AS k", "translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS w")
    text = F.expr("""CASE k % 6
      WHEN 0 THEN concat('José ', w, ' 48.3, Núñez ', w, ' 1:47.1 y') WHEN 1 THEN concat('Ann ', w, '48.31, Bo ', w, '’ c47.2')
      WHEN 2 THEN concat('Ann ', w, ', X 48.3, Bo ', w, ' 47.1, Cy ', w, ' 46.5, Di ', w, ' 45.0—fastest') WHEN 3 THEN concat('in heats: Ann ', w, ', Bo ', w, '; pulled up, Cy ', w, ',')
      WHEN 4 THEN concat('Ann ', w, ' 53.65 Bo ', w, ' 51.25') ELSE concat('Ann ', w, ''', Bo ', w, ''' Cy, Di ', w) END""")
    each = c.select("k", F.explode(lines.members(text)).alias("m"))
    # A quote that parts two names leaves a mark on neither; a time in yards keeps its blank.
    return each.select("k", F.col("m.leg_idx").alias("leg"), F.col("m.name").alias("name"), F.trim("m.split_time").alias("split_time"), F.col("m.is_international").alias("foreign_mark"))


@register(r"""
WITH c AS (SELECT c_custkey AS k, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS w FROM customer)
SELECT k, replace(content, '#', w) AS content, complete, note FROM c JOIN (VALUES (0, 'Ann #, Bo #', true, false), (1, 'Ann #, Bo #,', false, false), (2, NULL, true, true), (3, NULL, false, false), (4, NULL, false, true),
  (5, 'Ann #, Bo', false, false), (6, 'Cy # 45.1', true, false), (7, NULL, true, false)) AS v(kind, content, complete, note) ON k % 8 = kind""")
def member_line_kinds(t: Tables) -> DataFrame:
    c = spread(t.customer.select("c_custkey"), "c_custkey").selectExpr("c_custkey AS k", "translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS w")
    c = c.withColumn("line", F.expr("""CASE k % 8 WHEN 0 THEN concat('  (Ann ', w, ', Bo ', w, ');') WHEN 1 THEN concat('(Ann ', w, ', Bo ', w, ',') WHEN 2 THEN '(3:05.2 MR)' WHEN 3 THEN concat('[3]Team ', w)
      WHEN 4 THEN concat('* = ', w) WHEN 5 THEN concat('   Ann ', w, ', Bo') WHEN 6 THEN concat('   Cy ', w, ' 45.1)') ELSE '(12 teams)' END"""))
    return c.select("k", lines.member_line(F.col("line"))["content"].alias("content"), lines.member_line(F.col("line"))["complete"].alias("complete"), lines.is_note(F.col("line")).alias("note"))
