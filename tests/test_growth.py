"""Work of operators that must grow with their rows, and ties that must not depend on the order of rows."""

import io
from contextlib import redirect_stdout
from itertools import combinations
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import entity, profiles
from tallyloom.plans import catalog


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_sources_of_one_ordinal_do_not_depend_on_the_order_of_rows(spark):
    kind = "e int, ordinal long, page string, source string, categories array<string>, school_categories array<string>"
    rows = [(1, 5, "p", "other", ["c"], None), (1, 5, "p", "disambig", ["c"], None), (1, None, "p", "a", ["c"], None), (1, 9, "p", "b", ["c"], None)]
    redirects = spark.createDataFrame([("x", "y")], "page string, target string")
    of = lambda rows: profiles.merged_pages(spark.createDataFrame(rows, kind).coalesce(1), redirects, "e").first().source
    assert of(rows) == of(rows[::-1]) == "disambig"


def test_members_of_a_key_are_not_gathered(spark):
    results = spark.createDataFrame([(i, "A", "men", "X", 1990 + i) for i in range(8)] + [(9, "A", "men", "X", None)], "id int, name string, gender string, school string, year int")
    spans = [(11, 2, 1991, 1993), (12, 1, 1993, None), (13, 1, 1993, 1994), (14, 0, None, 1999), (15, 0, 1996, 1995), (16, None, 1997, 1997)]
    members = spark.createDataFrame([(i, o, "A", "men", "X", s, e) for i, o, s, e in spans], "athlete_id long, ordinal int, name string, gender string, school string, year_start int, year_end int")
    out = profiles.apply_profiles(results, members, spark.createDataFrame([], "name string, school string, gender string, id long"))[0]
    assert {r.id: r.athlete_id for r in out.collect()} == {0: 1, 1: 11, 2: 11, 3: 12, 4: 12, 5: 12, 6: 12, 7: 16, 9: 1}
    assert "collect_list" not in plan_of(out)


def test_edges_grow_with_rows(spark):
    sizes = [(7 * i * i) % 90 for i in range(200)] + [None]
    part = spark.createDataFrame([(i, "n", "b", s) for i, s in enumerate(sizes)] + [(300, "n", None, 1), (301, "n", None, 1), (302, "m", "b", 1)], "p_partkey long, p_name string, p_brand string, p_size int")
    edges = catalog.part_edges(SimpleNamespace(part=part)).collect()
    assert len(edges) <= 400
    root = list(range(len(sizes)))
    for a, b in combinations(range(200), 2):
        if abs(sizes[a] - sizes[b]) <= 5 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    assert {r.node: r.root for r in entity.components(spark.createDataFrame(edges)).collect()} == want


def test_candidate_pairs_are_not_shuffled(spark):
    people = ["Ann Lee", "Ann Lea", "Anne Lee", "A Lee", "ANN Lee", "Bo Lee", "Ann Ray", "Al Lee", "Ab Lee", None]
    rows = [(k, people[k % 10], ("women", "men", None)[k % 7 % 3], f"S{k % 4}", 1990 + k % 13, 1991 + k % 13, []) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, name string, gender string, school string, first_year int, last_year int, groups array<string>")
    got = entity.candidates(df)
    assert "(keys=[a#" not in plan_of(got)

    def edit(a, b):
        if len(a) < len(b):
            a, b = b, a
        return a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a))))

    def strategy(a, b):
        (ga, la), (gb, lb) = a[1].lower().split(), b[1].lower().split()
        (fa, fb), differ = (a[1].split()[0], b[1].split()[0]), a[1] != b[1]
        if not differ:
            return "exact" if a[3] != b[3] else None
        if fa == fb and la == lb and any(len(f) < 4 and f.isupper() for f in (fa, fb)):
            return "initials"
        if la == lb and min(len(ga), len(gb)) > 2 and edit(ga, gb):
            return "fuzzy"
        if la != lb and ga == gb and la[0] == lb[0] and min(len(la), len(lb)) > 2 and edit(la, lb):
            return "cross_fuzzy"
        near = max(b[4] - a[5], a[4] - b[5], 0) <= 8
        return "maiden_married" if a[2] == "women" and a[3] == b[3] and ga == gb and near else None

    pairs = [(a, b) for a, b in combinations(rows, 2) if a[1] and b[1] and a[2] and a[2] == b[2]]
    want = sorted((a[0], b[0], s) for a, b in pairs if (s := strategy(a, b)))
    assert sorted((r.a, r.b, r.strategy) for r in got.collect()) == want and {s for *_, s in want} >= {"exact", "fuzzy", "cross_fuzzy", "maiden_married"}


@pytest.mark.parametrize("most", [7, 4096])
def test_pairs_of_a_block_are_dealt_out(spark, monkeypatch, most):
    """A block of few bytes has many pairs; its parts meet in keys, and so in tasks, of their own."""
    monkeypatch.setattr(entity, "BLOCK_PART", most, raising=False)
    rows = [(None if k == 5 else k, "big" if k % 10 else "small", None if k % 11 == 3 else "x", k % 4) for k in range(130)] + [(200, "one", "x", 0), (201, None, "x", 0), (202, None, "x", 1)]
    df = spark.createDataFrame(rows, "id long, name string, kind string, size int")
    met = entity.blocked_pairs(df, "id", ["name", "kind"], F.col("a_size") != F.col("b_size"))
    assert met.columns == ["name", "kind", "a_id", "a_size", "b_id", "b_size"] and met.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert "Broadcast" not in plan_of(met).partition("SortMergeJoin")[0] and "REPARTITION_BY_NUM" in plan_of(met)
    tasks = [r.n for r in met.filter("name = 'big'").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert (len(tasks) > 4 and max(tasks) < sum(tasks) / 2) if most == 7 else len(tasks) == 1
    whole = [r for r in rows if None not in r]
    assert sorted(map(tuple, met.collect())) == sorted((*a[1:3], a[0], a[3], b[0], b[3]) for a in whole for b in whole if a[1:3] == b[1:3] and a[0] < b[0] and a[3] != b[3])


@pytest.mark.parametrize("name", ["team_members_lines", "member_line_kinds", "result_lines", "relay_lines"])
def test_lines_of_a_small_table_are_dealt_out(spark, name):
    """A table of one row group comes in one task, however many rows it has."""
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_last_names_of_other_first_letters_are_met(spark):
    people = [(1, "Ann Lee", "women", "S"), (2, "Ann Dee", "women", "S"), (3, "Jon Orr", "men", "S"), (4, "jon Korr", "men", "T"), (5, "Jon Ray", "men", "S"), (6, "Jim Dorr", "men", "S"), (7, "Ann Bo", "women", "T"), (8, "Ann Lo", "women", "U")]
    df = spark.createDataFrame(people, "id long, name string, gender string, school string").selectExpr("*", "2000 AS first_year", "2001 AS last_year", "CAST(array() AS array<string>) AS groups")
    assert sorted((r.a, r.b, r.strategy) for r in entity.candidates(df).collect()) == [(1, 2, "cross_fuzzy"), (3, 4, "cross_fuzzy")]


def test_pairs_of_alike_profiles_are_dealt_out(spark, monkeypatch):
    """Copies grow pairs with their square; parts of many alike rows and of large names meet in keys of their own."""
    monkeypatch.setattr(entity, "BLOCK_PART", 16, raising=False)
    monkeypatch.setattr(entity, "ALIKE_PART", 4, raising=False)
    kinds = [("Ann Lee", "S"), ("Anne Lee", "T"), ("Ann Lee", "T"), ("Ann Ray", "S"), ("Ann Lee", None)]
    rows = [(k, *kinds[k % 5], "women", 2000 + k % 2, 2001, []) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, school string, gender string, first_year int, last_year int, groups array<string>")
    got = entity.candidates(df)
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism

    def strategy(a, b):
        if {a[1], b[1]} == {"Ann Lee"}:
            return "exact" if a[2] and b[2] and a[2] != b[2] else None
        if {a[1], b[1]} == {"Ann Lee", "Anne Lee"}:
            return "fuzzy"
        return "maiden_married" if {a[1], b[1]} == {"Ann Lee", "Ann Ray"} and a[2] and a[2] == b[2] else None

    want = sorted((a[0], b[0], s) for a, b in combinations(rows, 2) if (s := strategy(a, b)))
    assert sorted((r.a, r.b, r.strategy) for r in got.collect()) == want and {s for *_, s in want} == {"exact", "fuzzy", "maiden_married"}
    assert all(entity.COMBINED[g].count(h) == entity.COMBINED[h].count(g) for g in entity.COMBINED for h in entity.COMBINED)
