"""Search, corrections of keys, imports, coverage, marks and joins: null, tie and order branches."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyloom.functions import marks
from tallyloom.operators import entity, joins, patches, quality, search


def test_search_predicates(spark):
    kind = "id int, name string, school string, discipline string, gender string, environment string, year int, place int, is_dq boolean, is_dnf boolean, is_dns boolean, is_wind_aided boolean, is_international boolean, is_relay boolean"
    no = (None,) * 6
    df = spark.createDataFrame([(1, "Ann Élan", "Rice", "Mile", "men", "indoor", 2000, 1, True, *no[1:]), (2, "ANNE", "Iowa_City", "60m", "women", "outdoor", 2001, None, *no), (3, None, None, None, None, None, None, 9, *no)], kind)
    found = lambda **w: sorted(r.id for r in search.search(df, search.Search(**w), "id").collect())
    assert found() == [1, 2, 3] and found(query="ann") == [1, 2] and found(query="rice") == [1] and found(name="élan") == [] and found(name="Élan") == [1]
    assert found(school="a_c") == [2] and found(school="%") == [1, 2] and found(gender="MEN") == [1] and found(environment="Outdoor", year_min=2001) == [2] and found(query="") == [1, 2, 3]
    assert found(is_dq=False) == [2, 3] and found(is_dq=True) == [1] and found(place_max=1) == [1] and found(place=9) == [3] and found(year_max=2000, discipline="mile") == [1]
    assert [r.id for r in search.search(df, search.Search(order_by="nonsense", descending=True, limit=2), "id").collect()] == [2, 1]
    assert search.count(df, search.Search(place_max=5)).first().n == 1


def test_corrections_of_keys(spark):
    df = spark.createDataFrame([(1, "A", 2000), (2, "B", 2000), (3, None, 2000)], "k int, s string, y int")
    kind = "ordinal int, k int, s string, corrections map<string,string>"
    of = lambda *rows: sorted(map(tuple, patches.correct(df, spark.createDataFrame(list(rows), kind), ["k"], optional=["s"]).collect()))
    assert of((1, 1, None, {"k": "2"}), (2, 2, "A", {"y": "1"}), (3, 1, None, {"y": "7"}), (4, 2, None, {"s": None})) == [(2, None, 1), (2, None, 2000), (3, None, 2000)]
    # A patch of the new key that comes before the one that gave it does nothing to the row.
    assert of((1, 2, None, {"y": "5"}), (2, 1, None, {"k": "2"})) == [(2, "A", 2000), (2, "B", 5), (3, None, 2000)]
    assert of((1, 1, None, {"k": "2"}), (2, 2, "A", {"k": "1"}), (3, 1, None, {"y": "9"})) == [(1, "A", 9), (2, "B", 2000), (3, None, 2000)]
    with pytest.raises(PySparkException, match="no such column to correct: z"):
        of((1, 1, None, {"z": "2"}))


def test_nulls_in_keys_of_upserts(spark):
    df = spark.createDataFrame([(1, "A", "x", 999, 1, None, None)], "id int, name string, school string, place int, is_dq int, is_relay boolean, leg_idx int")
    p = spark.createDataFrame([(1, "B", None, 3), (2, "B", None, 4), (3, "A", "x", 5), (4, "A", "x", 6)], "ordinal int, name string, school string, place int")
    p = p.withColumns({"is_relay": F.lit(None).cast("boolean"), "leg_idx": F.lit(None).cast("int")})
    got = patches.upsert_places(df, p, ["name", "school"], "id", "place", "name", ["is_dq"]).collect()
    assert sorted((r.name, r.school or "", r.place, r.is_dq) for r in got) == [("A", "x", 5, 0), ("B", "", 3, 0), ("B", "", 4, 0)]


def test_imports(spark):
    kind = "team int, school string, place int, leg_idx int, name string, is_relay boolean"
    df = spark.createDataFrame([(1, "R", None, 1, "Relay member unknown", True), (1, "R", None, 2, "Ann", True), (2, "R", 1, None, "Cy", False)], kind)
    e = [
        (1, "R", None, 1, "Bea", True, 1, None), (1, "R", None, 2, None, True, 2, False), (1, "R", None, 2, "", True, 3, False), (1, "", None, 3, None, True, 4, False), (2, "R", 1, None, "Cy", False, 5, False),
        (2, "R", None, None, "Cy", False, 6, False), (2, "R", 2, None, "Di", False, 7, False), (2, "R", 2, None, "Di", False, 8, False), (3, "R", 1, 1, None, True, 9, False), (3, "R", 1, 1, "Eva", True, 10, False),
        (4, "R", 1, 1, "Flo", True, 11, False), (4, "R", 1, 1, None, True, 12, False), (5, "R", 1, 1, "Gus", True, 13, True), (6, "R", 1, None, None, False, 14, False),
    ]
    got = patches.import_entries(df, spark.createDataFrame(e, f"{kind}, ordinal int, skip boolean"), ["team"]).collect()
    assert sorted((r.team, r.leg_idx or 0, r.name, r.place or 0) for r in got) == sorted([
        (1, 1, "Bea", 0), (1, 2, "Ann", 0), (1, 2, "Relay member unknown", 0), (2, 0, "Cy", 1), (2, 0, "Cy", 0), (2, 0, "Di", 2), (3, 1, "Eva", 1), (4, 1, "Flo", 1), (4, 1, "Relay member unknown", 1),
    ])


def test_coverage_marks_and_report(spark):
    df = spark.createDataFrame([("a", 2000), ("a", 2005), ("b", 2000), (None, 2000), ("a", None)], "k string, y int")
    ranges = spark.createDataFrame([("a", 1999, 2003), ("a", 2002, None), ("c", 2009, 2008)], "k string, start int, end int")
    got = quality.coverage(df, ranges, ["k"], "y", exclude=(2002,), before=2008)
    assert sorted(map(tuple, got.collect())) == [("fail", "", "2000"), ("fail", "b", "2000"), ("warn", "a", "1999"), ("warn", "a", "2001"), ("warn", "a", "2003-2004"), ("warn", "a", "2006-2007")]
    kind = "g string, id int, place int, mark double, is_dq boolean, is_dnf int, is_dns boolean, is_relay boolean, leg_idx int"
    rows = [("run", 1, 1, 10.0), ("run", 2, 2, 9.9), ("run", 3, 2, 9.8), ("run", 4, 999, 1.0), ("jump", 5, 1, 8.0), ("jump", 6, 2, 8.1), ("jump", 7, None, 9.0), ("jump", 8, 3, 8.0)]
    df = spark.createDataFrame([(*r, None, 0, False, r[1] == 8, 1 if r[1] == 8 else None) for r in rows], kind)
    found = quality.mark_order(df, ["g"], "place", "mark", "id", F.col("g") == "jump")
    assert sorted((r.g, r.previous_mark, r.mark, r.kind) for r in found.collect()) == [("jump", 8.0, 8.1, "field"), ("run", 9.9, 9.8, "running"), ("run", 10.0, 9.9, "running")]
    assert {r.rule: (r.n, r.failed) for r in quality.report([("order", found), ("none", df.filter("false"))]).collect()} == {"order": (3, True), "none": (0, False), "total": (3, True)}


def test_marks_by_hand(spark):
    texts = ["1:02.5c", "12.5m(A)", "150cm", "6-0.75", " 7.1+A", "4y", "?", "x", "", None, "5cA"]
    got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(marks.parse_missing_mark(F.col("t")).alias("m")).collect()]
    assert [(m.num if m.num is None else round(m.num, 4), m.cleaned, m.altitude, m.converted) for m in got] == [
        (62.5, "1:02.5c", False, True), (12.5, "12.5m(A)", True, False), (1.5, "150cm", False, False), (1.8479, "6-0.75", False, False), (7.1, "7.1+A", True, True), (4.0, "4y", False, False), (None, "?", False, False),
        (None, "x", False, False), (None, "", False, False), (None, None, False, False), (5.0, "5cA", True, True),
    ]


def test_lookups_that_must_be_unique_and_hubs(spark, monkeypatch):
    df, dim = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sorted((r.k or 0, r.v) for r in joins.lookup(df, dim, ["k"]).collect()) == [(0, None), (1, "a"), (2, "c")]
    with pytest.raises(PySparkException, match="a key twice: 1"):
        joins.lookup(df, dim, ["k"], unique=True).collect()
    monkeypatch.setattr(joins, "HUB_SHARE", 10)
    edges = spark.createDataFrame([(5, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 220)] + [(159, 200), (300, 301)], "a int, b int")
    assert {r.root: r.n for r in entity.components(edges).groupBy("root").count().withColumnRenamed("count", "n").collect()} == {5: 82, 300: 2}
