"""Profiles: assembly, application, dimension, redirects, pages, categories and keys."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyloom.operators import profiles


def test_profiles_are_applied_by_the_first_span_and_numbered_on(spark):
    results = spark.createDataFrame(
        [(1, "A’B", "men", "X", 2000), (2, "A'B", "men", "X", 2005), (3, "A'B", "men", "X", 1990), (4, "C", "men", "X", 2000), (5, "C", "men", None, 2000), (6, None, "men", "X", 2000), (7, "Relay member unknown", "men", "X", 2000), (8, "B", "men", "X", 2000), (9, "B", "men", "X", 1950)],
        "id int, name string, gender string, school string, year int",
    )
    members = spark.createDataFrame([(11, 2, "A'B", "men", "X", 1999, 2010), (12, 1, "A‘B", "men", "X", 2004, None), (13, 3, "A'B", "men", "X", 1999, 2001)], "athlete_id long, ordinal int, name string, gender string, school string, year_start int, year_end int")
    known = spark.createDataFrame([("C", "X", "men", 70), ("Z", "X", "men", 80)], "name string, school string, gender string, id long")
    out, new = profiles.apply_profiles(results.withColumn("athlete_id", F.lit(5)), members, known)
    assert {r.id: r.athlete_id for r in out.collect()} == {1: 11, 2: 12, 3: 81, 4: 70, 5: None, 6: None, 7: None, 8: 82, 9: 82}
    assert sorted((r.name, r.id) for r in new.collect()) == [("A'B", 81), ("B", 82)] and out.columns[-1] == "athlete_id"


def nodes(spark, *rows):
    return spark.createDataFrame([(n, "S", "men", 2000, 2003, rows_, i) for i, (n, rows_) in enumerate(rows)], "name string, school string, gender string, year_start int, year_end int, rows int, ordinal int")


def decisions(spark, *rows):
    return spark.createDataFrame([(i, f"{a}|S|men|1|2::{b}|S|men|1|2", d) for i, (a, b, d) in enumerate(rows)], "ordinal int, pair string, decision string")


def test_assembly(spark):
    n = nodes(spark, ("A", 5), ("B", 9), ("C", 1), ("D", 1), ("E", 2), ("F", 2), ("G", 3), ("H", 3))
    d = decisions(spark, ("A", "B", "same_a"), ("B", "C", "same_b"), ("D", "ghost", "same"), ("ghost", "E", "same_custom:Own"), ("nobody", "ghost2", "same_custom:No"), ("F", "A", "skip"), ("F", "A", "different"), ("G", "H", "same"))
    got = {r.canonical_name: ([m.name for m in r.members], r.aliases) for r in profiles.assemble(n, d).collect()}
    # A and C are preferred once each, and A earlier; G has as many rows as H and comes first.
    assert got == {"A": (["A", "B", "C"], ["A", "B", "C"]), "Own": (["D", "E"], ["D", "E", "Own"]), "F": (["F"], ["F"]), "G": (["G", "H"], ["G", "H"])}
    with pytest.raises(ValueError, match="different"):
        profiles.assemble(n, decisions(spark, ("A", "B", "same"), ("B", "A", "different")))
    assert profiles.assemble(n, decisions(spark, ("A", "B", "same"), ("B", "A", "different")), abort=False).count() == 7


def test_dimension_and_its_assertions(spark):
    kind = "name string, category string, nicknames array<struct<nickname:string,used_by:string>>"
    schools = spark.createDataFrame([("Rice", "c", [("Owls", None), ("Ladies", "women"), ("Hens", "women")]), ("Iowa", None, None)], kind)
    d = profiles.school_dimension(schools, ["name"])
    assert sorted(map(tuple, d.collect())) == [(1, "Iowa", None, None, None), (2, "Rice", "c", "Owls", "Hens")]
    results = spark.createDataFrame([(1, "Rice"), (2, "Yale"), (3, None)], "id int, school string")
    assert profiles.with_school_ids(results.filter("id = 1"), d).first().school_id == 2
    assert {r.id: r.school_id for r in profiles.with_school_ids(results, d, abort=False).collect()} == {1: 2, 2: None, 3: None}
    for i, said in ((2, "Yale"), (3, "null")):
        with pytest.raises(PySparkException, match=f"no such school: {said}"):
            profiles.with_school_ids(results.filter(f"id = {i}"), d).collect()
    with pytest.raises(PySparkException, match="a school twice"):
        profiles.school_dimension(schools.unionByName(schools), ["name"]).collect()


@pytest.mark.parametrize("seed", range(3))
def test_redirects_by_brute_force(spark, seed):
    rng = random.Random(seed)
    to = {f"p{i}": f"p{rng.randint(0, 60)}" for i in rng.sample(range(60), 40)} | {f"c{i}": f"c{i + 1}" for i in range(37)} | {"self": "self"}
    want = {}
    for page in to:
        at, seen = page, set()
        while at in to and to[at] != at and at not in seen:
            seen.add(at)
            at = to[at]
        if at not in seen and at != page:
            want[page] = at
    got = profiles.resolved_redirects(spark.createDataFrame(list(to.items()), "page string, target string"))
    assert {r.page: r.target for r in got.collect()} == want and got.count() == len(want)


def test_pages_are_merged(spark):
    kind = "e int, ordinal int, page string, source string, categories array<string>, school_categories array<string>"
    matches = spark.createDataFrame([(1, 1, "a", "disambig", ["y"], None), (1, 2, "b", "exact", ["x"], ["s"]), (1, 3, "z", "exact", [], []), (2, 1, "a", "disambig", ["q"], []), (2, 2, "k", "exact", None, ["t"])], kind)
    got = profiles.merged_pages(matches, spark.createDataFrame([("a", "b"), ("b", "c")], "page string, target string"), "e")
    assert sorted((r.e, r.page, r.source, r.categories, r.school_categories, r.needs_review) for r in got.collect()) == [(1, "c", "exact", ["x", "y"], ["s"], False), (2, "c", "disambig", ["q"], [], True), (2, "k", "exact", [], ["t"], True)]


def test_cache_partition_and_stable_keys(spark):
    cache = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("gone", 3, "x")], "key string, at int, v string")
    valid, stale = profiles.partitioned_cache(cache, spark.createDataFrame([("k",), ("k",), ("j",)], "key string"), "key", "at")
    assert [r.v for r in valid.collect()] == ["new"] and [r.key for r in stale.collect()] == ["gone"]
    kind = "c string, m array<struct<school:string,gender:string,year_start:int,year_end:int>>"
    df = spark.createDataFrame([("A", [("Y", "men", 2001, 2003), ("X", "men", None, 2009), ("", "men", 1999, None), ("X", "men", 2005, 2006)]), ("A", [("X", "men", 1999, 2009), ("Y", "men", 2001, 2001)]), (None, [])], kind)
    assert [r.k for r in df.select(profiles.stable_key(F.col("c"), F.col("m")).alias("k")).collect()] == ["A|X;Y|men|1999|2009"] * 2 + ["None||None|None|None"]


def test_categories(spark):
    schools = spark.createDataFrame([("R", "Category:Rice Owls and Ladies", "Owls", "Ladies"), ("I", "Category:Iowa Hawks", "Hawks", "Hawks"), ("N", None, None, None)], "name string, category string, men_nickname string, women_nickname string")
    kind = "e int, canonical_name string, gender string, schools array<string>, matches array<struct<page:string,categories:array<string>>>"
    rice, iowa = "Category:Rice Ladies track and field athletes", "Category:Iowa Hawks women's track and field athletes"
    entries = [
        (1, "Ann", "women", ["R", "I"], [("p", [rice]), ("q", None)]), (2, "Bea", "women", ["R"], [("p", [rice.upper(), "x"]), ("q", [])]), (3, "Cy", None, ["R"], [("p", [])]), (4, "Di", "women", ["N", "?"], [("p", [])]),
        (5, "Eva", "women", ["R"], [("p", [])]), (6, "Flo", "women", [], [("p", [])]), (7, "Gus", "men", ["R"], [("p", None)]),
    ]
    reviewed = spark.createDataFrame([("Eva", "p"), ("Ann", "q")], "canonical_name string, page string")
    got = profiles.category_suggestions(spark.createDataFrame(entries, kind), schools, reviewed, "e").collect()
    assert sorted((r.e, r.pages, r.expected) for r in got) == [(1, ["p"], [iowa, rice]), (7, ["p"], ["Category:Rice Owls track and field athletes"])]


def test_small_ones(spark):
    df = spark.createDataFrame([(1, ["José", "Jose", "Ann"]), (2, None)], "i int, a array<string>")
    assert {r.i: r.v for r in profiles.name_variants(df, "a", "v").collect()} == {1: ["José", "Jose", "Ann"], 2: []}
    assert [r.s for r in spark.createDataFrame([(["a"],), (["a", "b"],), ([],), (None,)], "f array<string>").select(profiles.school_state(F.col("f")).alias("s")).collect()] == ["resolved", "ambiguous", "fallback", "fallback"]
    out = profiles.displayed(spark.createDataFrame([(1, "raw"), (2, "raw2")], "id int, name string"), spark.createDataFrame([(1, "Shown")], "id int, canonical string"), "id", "canonical", "name", "display")
    assert {r.id: r.display for r in out.collect()} == {1: "Shown", 2: "raw2"}
