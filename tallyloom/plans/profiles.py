"""Queries over profiles: application, assembly, dimension, pages, categories and keys, bound to customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import profiles
from tallyloom.plans.registry import Tables, register

WORD = "translate(CAST({} AS STRING), '0123456789', 'abcdefghij')"


@register("""
WITH members AS (
  SELECT 10000 + c_custkey AS id, c_custkey AS ordinal, 'N' || (c_custkey % 50) AS name, substr('FOP', CAST(c_custkey % 3 + 1 AS INTEGER), 1) AS gender, CAST(c_custkey % 4 + 1 AS VARCHAR) AS school,
    1992 + c_custkey % 5 AS s, CASE WHEN c_custkey % 6 > 0 THEN 1993 + c_custkey % 5 END AS e FROM customer),
results AS (SELECT o_orderkey, CASE WHEN o_custkey % 13 > 0 THEN CASE WHEN o_custkey % 17 > 0 THEN 'N' || (o_custkey % 50) ELSE 'Relay member unknown' END END AS name, o_orderstatus AS gender, substr(o_orderpriority, 1, 1) AS school, year(o_orderdate) AS year FROM orders),
first AS (SELECT o_orderkey, arg_min(m.id, m.ordinal) AS id FROM results r JOIN members m ON r.name = m.name AND r.gender = m.gender AND r.school = m.school AND r.year >= m.s AND (m.e IS NULL OR r.year <= m.e) GROUP BY 1),
left_over AS (SELECT DISTINCT name, gender, school FROM results LEFT JOIN first USING (o_orderkey) WHERE id IS NULL AND name <> 'Relay member unknown'),
known AS (SELECT 'N' || n_nationkey AS name, 'F' AS gender, '1' AS school, 90000 + n_nationkey AS id FROM nation),
ids AS (
  SELECT name, gender, school, id FROM left_over JOIN known USING (name, gender, school)
  UNION ALL SELECT name, gender, school, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY name, gender, school) FROM (SELECT * FROM left_over ANTI JOIN known USING (name, gender, school)))
SELECT o_orderkey, CAST(coalesce(f.id, i.id) AS BIGINT) AS athlete_id FROM results r LEFT JOIN first f USING (o_orderkey) LEFT JOIN ids i ON r.name = i.name AND r.gender = i.gender AND r.school = i.school""")
def profile_apply(t: Tables) -> DataFrame:
    members = t.customer.selectExpr("10000 + c_custkey AS athlete_id", "c_custkey AS ordinal", "concat('N', c_custkey % 50) AS name", "substr('FOP', CAST(c_custkey % 3 + 1 AS INT), 1) AS gender", "CAST(c_custkey % 4 + 1 AS STRING) AS school", "1992 + c_custkey % 5 AS year_start", "CASE WHEN c_custkey % 6 > 0 THEN 1993 + c_custkey % 5 END AS year_end")
    name = "CASE WHEN o_custkey % 13 > 0 THEN CASE WHEN o_custkey % 17 > 0 THEN concat('N', o_custkey % 50) ELSE 'Relay member unknown' END END AS name"
    results = t.orders.selectExpr("o_orderkey", name, "o_orderstatus AS gender", "substr(o_orderpriority, 1, 1) AS school", "year(o_orderdate) AS year")
    known = t.nation.selectExpr("concat('N', n_nationkey) AS name", "'F' AS gender", "'1' AS school", "90000 + n_nationkey AS id")
    return profiles.apply_profiles(results, members, known)[0].select("o_orderkey", "athlete_id")


PROFILES_SQL = """
WITH n AS (SELECT c_custkey AS k, 'Ann O''' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS name, 'S' || (c_custkey % 6) AS school, 1950 + c_custkey % 30 AS s, 1950 + c_custkey % 30 + c_custkey % 4 AS e, c_custkey % 9 AS rows FROM customer),
groups AS (SELECT *, CASE WHEN k % 5 = 3 THEN k ELSE greatest(k - (k + 1) % 5, 1) END AS g FROM n),
hints AS (
  SELECT g, CASE k % 5 WHEN 4 THEN (SELECT b.name FROM n b WHERE b.k = a.k + 1) WHEN 0 THEN name WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'X' || k END END AS hint, CASE WHEN k % 5 = 1 THEN 0 ELSE 1 END AS source, k FROM groups a WHERE k % 5 IN (4, 0, 1) AND k < (SELECT max(k) FROM n)),
names AS (SELECT g, hint AS name, source, count(*) AS c, min(k) AS k FROM hints WHERE hint IS NOT NULL GROUP BY g, hint, source UNION ALL SELECT g, name, 2, rows, k FROM groups),
chosen AS (SELECT g, name FROM names QUALIFY row_number() OVER (PARTITION BY g ORDER BY source, c DESC, k) = 1)
SELECT c.name AS canonical_name, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(list(m.name) || [c.name]) AS x)) AS aliases, string_agg(m.name || ':' || school || ':' || s || ':' || e, ',' ORDER BY m.k) AS members
FROM groups m JOIN chosen c USING (g) GROUP BY g, c.name
"""


@register(PROFILES_SQL)
def assembled_profiles(t: Tables) -> DataFrame:
    """Customers in chains of four by decisions that name spans of years ago and curly quotes, ghosts that nobody knows,
    names set by hand or preferred, different and open pairs."""
    base = t.customer.selectExpr("c_custkey AS ordinal", f"concat('Ann O''', {WORD.format('c_custkey')}) AS name", "concat('S', c_custkey % 6) AS school", "'women' AS gender", "1950 + c_custkey % 30 AS year_start", "1950 + c_custkey % 30 + c_custkey % 4 AS year_end", "c_custkey % 9 AS rows")
    side = lambda k, old: f"concat('Ann O’', {WORD.format(k)}, '|S', {k} % 6, '|women|', {old}, '|', {old})"
    decision = "CASE k % 5 WHEN 4 THEN 'same_b' WHEN 0 THEN 'same_a' WHEN 1 THEN CASE WHEN k % 3 = 0 THEN concat('same_custom:X', k) ELSE 'same' END WHEN 2 THEN 'different' ELSE 'skip' END"
    decisions = t.customer.selectExpr("c_custkey AS k", "max(c_custkey) OVER () AS last").filter("k < last").selectExpr("k AS ordinal", f"concat({side('k', 1900)}, '::', {side('(k + 1)', 1901)}) AS pair", f"{decision} AS decision")
    ghosts = t.customer.selectExpr("10000000 + c_custkey AS ordinal", "concat('Ghost ', c_custkey, '|S|women|1900|1901::Ghost ', c_custkey + 1, '|S|women|1900|1901') AS pair", "'same_custom:Nobody' AS decision")
    out = profiles.assemble(base, decisions.unionByName(ghosts))
    member = F.transform("members", lambda m: F.concat_ws(":", m["name"], m["school"], m["year_start"].cast("string"), m["year_end"].cast("string")))
    return out.select("canonical_name", F.array_join("aliases", ",").alias("aliases"), F.array_join(member, ",").alias("members"))


@register("""
WITH s AS (SELECT s_suppkey AS k, s_name AS name FROM supplier)
SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS school_id, name, CASE k % 4 WHEN 0 THEN 'Lions' || k WHEN 1 THEN 'Lions' || k WHEN 2 THEN 'Both' || k END AS men_nickname, CASE k % 4 WHEN 0 THEN 'Ladies' || k WHEN 1 THEN 'Both' || k WHEN 2 THEN 'Both' || k END AS women_nickname,
  (SELECT count(*) FROM lineitem WHERE l_suppkey = k) AS n_results FROM s""")
def school_dimension(t: Tables) -> DataFrame:
    """Suppliers as schools, whose nicknames come as lists; every line has its school's identifier, or the job fails."""
    nick = lambda text, of: f"named_struct('nickname', concat('{text}', s_suppkey), 'used_by', {of})"
    lists = f"CASE s_suppkey % 4 WHEN 0 THEN array({nick('Old', 'NULL')}, {nick('Lions', chr(39) + 'men' + chr(39))}, {nick('Ladies', chr(39) + 'women' + chr(39))}) WHEN 1 THEN array({nick('Both', 'NULL')}, {nick('Lions', chr(39) + 'men' + chr(39))}) WHEN 2 THEN array({nick('Lions', chr(39) + 'men' + chr(39))}, {nick('Both', 'NULL')}) ELSE array() END"
    dimension = profiles.school_dimension(t.supplier.selectExpr("s_name AS name", f"CAST({lists} AS array<struct<nickname:string,used_by:string>>) AS nicknames"), ["name"])
    results = t.lineitem.join(t.supplier.selectExpr("s_suppkey AS l_suppkey", "s_name AS school"), "l_suppkey").select("l_orderkey", "school")
    counts = profiles.with_school_ids(results, dimension).groupBy("school_id").agg(F.count("*").alias("n_results"))
    return dimension.join(counts, "school_id", "left").fillna(0, ["n_results"])


@register("""
WITH target AS (SELECT p_partkey AS page, CASE WHEN (p_partkey - p_partkey % 8) % 64 IN (16, 24) THEN p_partkey ELSE p_partkey - p_partkey % 8 END AS target FROM part),
m AS (SELECT l_orderkey, CAST(t.target AS VARCHAR) AS page, l_linenumber * 1000000 + l_partkey AS ordinal, CASE WHEN l_returnflag = 'R' THEN 'exact' WHEN l_returnflag = 'A' THEN 'disambig' ELSE 'other' END AS source, l_shipmode AS category, l_quantity > 25 AS has
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_returnflag, l_shipmode, l_quantity FROM lineitem) JOIN target t ON t.page = l_partkey WHERE l_quantity > 25 OR l_linenumber % 2 = 0),
g AS (SELECT l_orderkey, page, CASE WHEN bool_or(source = 'exact') THEN 'exact' ELSE arg_min(source, ordinal) END AS source, coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (has), '') AS categories FROM m GROUP BY 1, 2)
SELECT *, count(*) OVER (PARTITION BY l_orderkey) > 1 AS needs_review FROM g""".replace("l_shipmode", "l_linestatus"))
def page_merge(t: Tables) -> DataFrame:
    """Parts as pages that redirect to the next lower one down to a multiple of 8; some of these redirect in a circle."""
    down = t.part.selectExpr("CAST(p_partkey AS STRING) AS page", "CAST(CASE WHEN p_partkey % 8 > 0 THEN p_partkey - 1 WHEN p_partkey % 64 = 16 THEN p_partkey + 8 WHEN p_partkey % 64 = 24 THEN p_partkey - 8 ELSE p_partkey END AS STRING) AS target")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity").distinct()
    source = "CASE WHEN l_returnflag = 'R' THEN 'exact' WHEN l_returnflag = 'A' THEN 'disambig' ELSE 'other' END AS source"
    matches = rows.selectExpr("l_orderkey", "l_linenumber * 1000000 + l_partkey AS ordinal", "CAST(l_partkey AS STRING) AS page", source, "CASE WHEN l_quantity > 25 THEN array(l_linestatus) ELSE CAST(array() AS array<string>) END AS categories", "CASE WHEN l_linenumber % 2 = 0 THEN array('x') END AS school_categories")
    return profiles.merged_pages(matches, down, "l_orderkey").select("l_orderkey", "page", "source", F.array_join("categories", ",").alias("categories"), "needs_review")


@register("""
WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Lions and Ladies' WHEN s_suppkey % 3 = 1 THEN 'Bears' END AS mascots FROM supplier),
c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'men' WHEN c_custkey % 7 > 0 THEN 'women' END AS gender FROM customer),
expected AS (
  SELECT DISTINCT k, 'S' || s_suppkey || ' ' || CASE WHEN s_suppkey % 3 = 0 THEN CASE WHEN gender = 'men' THEN 'Lions' ELSE 'Ladies' END ELSE 'Bears' || CASE WHEN gender = 'men' THEN ' men''s' ELSE ' women''s' END END || ' track and field athletes' AS category
  FROM c JOIN s ON s_suppkey IN (k % 10 + 1, k % 7 + 1) WHERE mascots IS NOT NULL AND gender IS NOT NULL),
open_pages AS (SELECT k, page FROM c, (VALUES ('A'), ('B')) AS p(page) WHERE NOT (page = 'A' AND k % 5 = 0) AND NOT (page = 'B' AND k % 4 > 0)),
e AS (SELECT k, string_agg(category, ',' ORDER BY category) AS expected FROM expected GROUP BY k),
p AS (SELECT k, string_agg(page, ',' ORDER BY page) AS pages, bool_or(page = 'B') AS has_b FROM open_pages GROUP BY k)
SELECT k, 'Name ' || k AS canonical_name, pages, expected FROM e JOIN p USING (k) WHERE NOT (has_b AND k % 3 = 0)""")
def category_suggestions(t: Tables) -> DataFrame:
    """Customers with up to two open pages; page B of every third has all categories that are called for, in capitals."""
    schools = t.supplier.selectExpr("s_suppkey", "concat('S', s_suppkey) AS name", "CASE s_suppkey % 3 WHEN 0 THEN concat('S', s_suppkey, ' Lions and Ladies') WHEN 1 THEN concat('S', s_suppkey, ' Bears') END AS category", "CASE WHEN s_suppkey % 3 = 0 THEN 'Lions' ELSE 'Bears' END AS men_nickname", "CASE WHEN s_suppkey % 3 = 0 THEN 'Ladies' ELSE 'Bears' END AS women_nickname")
    c = t.customer.selectExpr("c_custkey AS k", "concat('Name ', c_custkey) AS canonical_name", "CASE WHEN c_custkey % 2 = 0 THEN 'men' WHEN c_custkey % 7 > 0 THEN 'women' END AS gender", "array(concat('S', c_custkey % 10 + 1), concat('S', c_custkey % 7 + 1)) AS schools")
    full = c.select("k", "gender", F.explode("schools").alias("name")).join(schools.filter("category IS NOT NULL"), "name").groupBy("k").agg(F.collect_set(F.upper(profiles.team_category(F.col("category"), F.col("men_nickname"), F.col("women_nickname"), F.col("gender")))).alias("all"))
    none = "CAST(array('x') AS array<string>)"
    matches = f"CASE WHEN k % 4 = 0 THEN array(named_struct('page', 'A', 'categories', {none}), named_struct('page', 'B', 'categories', CASE WHEN k % 3 = 0 THEN all ELSE {none} END)) ELSE array(named_struct('page', 'A', 'categories', {none})) END AS matches"
    entries = c.join(full, "k", "left").selectExpr("k", "canonical_name", "gender", "schools", matches)
    reviewed = t.customer.filter("c_custkey % 5 = 0").selectExpr("concat('Name ', c_custkey) AS canonical_name", "'A' AS page")
    out = profiles.category_suggestions(entries, schools, reviewed, "k")
    return out.select("k", "canonical_name", F.array_join("pages", ",").alias("pages"), F.array_join("expected", ",").alias("expected"))


@register("SELECT c_custkey, n_nationkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 4 < 3")
def stable_key_join(t: Tables) -> DataFrame:
    """Customers' profiles meet those of an outside file by a key of their nested members, which come in another order
    there; a quarter of them has other years and meets nothing."""
    member = lambda k, s, gap: f"named_struct('school', concat('S', {k} % {s}), 'gender', 'men', 'year_start', 1950 + {k} % {s} - {gap}, 'year_end', 1960 + {k} % {s})"
    own = t.customer.selectExpr("c_custkey", f"array({member('c_custkey', 5, 0)}, {member('c_custkey', 7, 0)}, {member('c_custkey', 5, 0)}) AS members").withColumn("key", profiles.stable_key(F.concat(F.lit("N"), "c_custkey"), F.col("members")))
    outside = t.customer.selectExpr("c_custkey AS k", "c_nationkey", f"array({member('c_custkey', 7, 'CASE WHEN c_custkey % 4 < 3 THEN 0 ELSE 9 END')}, {member('c_custkey', 5, 0)}) AS members")
    outside = outside.withColumn("key", profiles.stable_key(F.concat(F.lit("N"), "k"), F.col("members"))).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return own.join(outside, "key").select("c_custkey", "n_nationkey", F.col("r_name").alias("region"))
