"""Marks, names, lines, patches, entities, windows and sinks on literal rows, each with its odd cases."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import lines, marks, names
from tallyloom.operators import aggregates, entity, joins, patches, quality, stages, windows
from tallyloom.plans.catalog import CLASSES
from tallyloom.sources import readers, sinks


def applied(spark, f, *rows):
    """f's result for each row of arguments, all of them strings or all numbers."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    kinds = ["long" if any(isinstance(r[i], int) for r in rows) else "string" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n long, " + ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    plain = lambda x: tuple(map(plain, x)) if isinstance(x, (tuple, list)) else x
    return [plain(r.x) for r in df.select("n", f(*[F.col(f"c{i}") for i in range(len(kinds))]).alias("x")).orderBy("n").collect()]


def test_outdoor_marks(spark):
    got = applied(spark, marks.parse_mark, "12.34m", "10.5+", "9.8W", "c10.1", "9.9/10.0", "3:59.4", "6-6-.25", "26–8¼", "10.1(A)", "51.2y", "?", "nt", None, "DQ", "1:2:3", "-", "45.6h*")
    numbers = [None if g[0] is None else round(g[0], 4) for g in got]
    assert numbers == [12.34, 10.5, 9.8, 10.1, 9.9, 239.4, round(6 * 0.3048 + 6.25 * 0.0254, 4), round(26 * 0.3048 + 8.25 * 0.0254, 4), 10.1, 51.2, None, None, None, None, None, None, 45.6]
    assert [g[2] for g in got].count(True) == 1 and got[2][2] and [g[3] for g in got].count(True) == 1 and got[1][3]
    assert got[0][1] == "12.34m" and got[4][1] == "9.9" and got[13][1] == "DQ" and got[11][1] is None


def test_indoor_marks(spark):
    got = applied(spark, marks.parse_indoor_mark, ("6,013", "multi"), ("4.45m14-7¼", "field"), ("---AA", "field"), ("---0-0", "field"), ("00A", "track"), ("3:02.51", "relay"), ("46.91 = 47", "track"), ("7.01c", "track"), ("x", "track"), (None, "track"), ("1:02:03.5", "track"))
    assert [g[0] for g in got] == [6013.0, 4.45, None, None, None, pytest.approx(182.51), 46.91, 7.01, None, None, 3723.5]
    assert got[0][1] == "6013" and got[1][1] == "4.45m" and got[5][1] == "3:02.51" and got[7][2] and not got[6][2] and got[2][1] is None


def test_places_winds_and_gaps(spark):
    assert applied(spark, marks.parse_place, "(3)", "(0)", "(DQ)", "(3 DNF)", "(dns)", "7", None) == [(3, None), (None, "DNF"), (None, "DQ"), (3, "DNF"), (None, "DNS"), (None, None), (None, None)]
    assert applied(spark, marks.sentinel_status, (999, "10.1"), (999, ""), (999, None), (3, "x")) == ["DQ", "DNF", "DNF", None]
    assert applied(spark, marks.parse_wind, "Wind +1.2", "wind -0.4 m", "none") == [1.2, -0.4, None]
    assert applied(spark, marks.span_gap, (1, 3, 5, 6), (5, 6, 1, 3), (1, 4, 4, 9)) == [2, 2, 0]


def test_names(spark):
    assert applied(spark, lambda a: names.clean_school(a, {"Tex": "Texas"}), "Tex....*", "Rice¶") == ["Texas", "Rice"]
    split = [({"LIU"}, 2019, "LIU Brooklyn", "Long Island")]
    assert applied(spark, lambda a, y: names.clean_school(a, {}, y, split), ("LIU", 2018), ("LIU", 2019), ("Rice", 2018)) == ["LIU Brooklyn", "Long Island", "Rice"]
    assert applied(spark, lambda a: names.parse_class(a, CLASSES), "Jr", "xSox", "So-Jr", "none") == ["junior", "sophomore", "junior", None]
    assert applied(spark, lambda a: names.name_and_class(a, {"SR": "senior", "JR": "junior"}), "Jordan ANTHONYJR", "Jo LEE") == [("Jordan ANTHONY", "junior"), ("Jo LEE", None)]
    assert applied(spark, names.first_name, "Ann Lee") == ["ann"] and applied(spark, names.last_name, "Ann van Lee") == ["lee"]
    assert applied(spark, names.initials_match, ("J.T. Smith", "JT Smith"), ("Jt Smith", "JT Smith"), ("Ann Lee", "Ann Lee"), ("JT Smith", "JT Smyth")) == [True, False, False, False]
    assert applied(spark, names.international, "Ann Lee'", "Ann Lee’", "O'Hara") == [("Ann Lee", True), ("Ann Lee", True), ("O'Hara", False)]
    assert applied(spark, names.capitalised, "ann lee", "") == ["Ann lee", ""] and applied(spark, names.squeeze, " a \u00a0 b ") == ["a b"]
    assert applied(spark, lambda t: names.page_url("http://x/", t), "A & B") == ["http://x/A_%26_B"]
    assert applied(spark, names.nicknames, ("Owls", "Owls"), ("Owls", None)) == [("Owls",), ("Owls",)]
    assert applied(spark, names.year_span, (2001, 2001), (2001, 2004)) == ["2001", f"2001{names.SPAN_DASH}2004"] and applied(spark, names.straight_quotes, "’") == ["'"]


def test_result_lines(spark):
    assert applied(spark, lines.placed, "=+3. x y", "12, z", "no place", None) == [(3, "x y", True), (12, "z", False), (None, None, False), (None, None, None)]
    got = applied(spark, lambda a: lines.individual(a, CLASSES, {"UCLA": "California, Los Angeles"}), "Carl Lewis' (Houston) ..... So 10.00w MR", "A Bee (UCLA) (injured) .... 9.9/10.0", "C Dee (Texas A&M ...... Jr 46.2", "no school here", "E Eff (Miami (Fla.)).. Sr 7-0¼ '41")
    assert got[0] == ("Carl Lewis", "Houston", "sophomore", 10.0, "10.00", True, True, False)
    assert got[1][:5] == ("A Bee", "California, Los Angeles", None, 9.9, "9.9") and got[2][:4] == ("C Dee", "Texas A&M", "junior", 46.2) and got[3] is None
    assert got[4][0] == "E Eff" and got[4][2] == "senior"


def test_relay_lines(spark):
    got = applied(spark, lambda a: lines.relay(a, {}), "Rice ...... 3:05.53", "Rice 3:05.53+", "BYU3:02.51", "Rice DNF", "Texas")
    assert [g[0] for g in got] == ["Rice", "Rice", "BYU", "Rice", "Texas"] and [g[1] for g in got] == [185.53, 185.53, 182.51, None, None]
    assert got[1][4] and got[3][6] and not got[3][5]
    status = applied(spark, lambda a: lines.relay_status(a, {}), "[1]Texas Tech [37.93] ....", "[2]Rice .... [3:05.5]", "Baylor [40.1] ......", "Navy .....", "Army (personnel unknown).", "3. Rice")
    assert [s and (s[0], s[1], s[3]) for s in status] == [("Texas Tech", 37.93, 1), ("Rice", 185.5, 2), ("Baylor", 40.1, None), ("Navy", None, None), ("Army", None, None), None]
    members = applied(spark, lambda a: F.transform(lines.members(a), lambda m: F.struct(m["name"], m["split_time"])), "Ann Lee 48.3, Bo Cruz 47.1,", "in heats: Ann Lee, Bo Cruz", "M Stevenson [miss] Robert Parham", "Krystin Lacy 53.65 Nicole Leach 51.25", "Ann O’Hara 1:52.3—fastest", "")
    assert members == [(("Ann Lee", "48.3"), ("Bo Cruz", "47.1")), (("Ann Lee", None), ("Bo Cruz", None)), (("M Stevenson", None), ("Robert Parham", None)), (("Krystin Lacy", "53.65"), ("Nicole Leach", "51.25")), (("Ann O'Hara", "1:52.3"),), ()]


def test_section_lines(spark):
    assert applied(spark, lines.year_header, "\f1987", "1987 x", "19870") == [1987, None, None]
    assert applied(spark, lines.meet_date, "(June 7–9)", "(Eugene, Ore, June 7–9; x", "(Austin; July 1)", "June 7") == ["June 7", "June 7", "July 1", None]
    assert applied(spark, lines.location, "(Eugene, Ore, June 7–9; x", "(Austin; July 1)", "(June 7)") == ["Eugene, Ore", "Austin", None]


def test_patches_in_order_and_by_column(spark):
    rows = spark.createDataFrame([(1, "old", 5), (None, "x", 1)], "id long, name string, place int")
    fixes = spark.createDataFrame([(1, 1, "new", None), (1, 2, None, 9), (None, 3, "y", None)], "id long, ordinal int, name string, place int")
    values = {"name": "name", "place": "place"}
    assert sorted(map(tuple, patches.update_rows(rows, fixes, ["id"], values).collect()), key=str) == sorted([(1, "new", 9), (None, "y", 1)], key=str)
    assert patches.update_rows(rows, fixes.filter("false"), ["id"], values).count() == 2
    chained = spark.createDataFrame([(1, 1, "a", "old"), (1, 2, "b", "a"), (1, 3, "c", "old")], "id long, ordinal int, name string, was string")
    assert patches.update_rows(rows, chained, ["id"], {"name": "name"}, match={"name": "was"}).filter("id = 1").first().name == "b"
    maps = spark.createDataFrame([(1, {"name": "a"}, 1, None), (1, {"place": None}, 2, "a"), (1, {"name": "z"}, 3, "old")], "id long, corrections map<string,string>, ordinal int, name string")
    assert tuple(patches.correct(rows, maps, ["id"], ["name"]).filter("id = 1").first()) == (1, "a", None)
    new = spark.createDataFrame([(7, "a", 1), (7, "b", 2), (1, "no", 3), (None, "no", 3)], "id long, name string, place int")
    assert [tuple(r) for r in patches.insert_missing(rows, new, ["id"]).filter("id = 7").collect()] == [(7, "a", 1)] and patches.insert_missing(rows, new, ["id"]).count() == 3
    up = spark.createDataFrame([(1, "u", 1, 1), (1, "v", 2, 2), (8, "w", 3, 3)], "id long, name string, place int, ordinal int")
    assert {r.name for r in patches.upsert(rows, up, ["id"]).collect()} == {"x", "v", "w"}
    cases = spark.createDataFrame([(1, "5"), (1, "6")], "id long, keep string")
    assert patches.keep_places(rows, cases, ["id"], "place").count() == 2


def test_upsert_of_a_whole_team(spark):
    rows = spark.createDataFrame([(1, "Ann", 999, 1, None)], "id long, name string, place int, is_dnf int, leg_idx int")
    fixes = spark.createDataFrame([("Ann", 1, 2, False, None), ("Relay member unknown", 2, 4, True, None), ("tie", 3, 1, False, None)], "name string, ordinal int, place int, is_relay boolean, leg_idx int")
    got = patches.upsert_places(rows, fixes, ["name"], "id", "place", "name", ["is_dnf"]).collect()
    assert sorted((r.name, r.place, r.is_dnf, r.leg_idx or 0) for r in got) == [("Ann", 2, 0, 0), *(("Relay member unknown", 4, 0, k) for k in (1, 2, 3, 4))]


def test_entities(spark):
    words = ["idiot", "idot", "idiots", "adiot", "other", "", "x", "xy", "abab", "baba", None]
    rows = spark.createDataFrame([(i, "b", w) for i, w in enumerate(words)], "id long, block string, name string")

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    want = {(i, j) for j, b in enumerate(words) for i, a in enumerate(words[:j]) if a is not None and b is not None and distance(a, b) <= 1}
    assert {(r.a_id, r.b_id) for r in entity.one_edit_pairs(rows, "id", ["block"], "name").collect()} == want
    groups = spark.createDataFrame([(["100m", "odd"], ["Long Jump"]), (["100m"], ["Shot Put"]), (["Mile"], []), (["Shot Put"], ["Decathlon"])], "a array<string>, b array<string>")
    assert [r.x for r in groups.select(entity.compatible(entity.event_groups("a"), entity.event_groups("b")).alias("x")).collect()] == [True, False, True, True]
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)], "node long, root long")
    known = spark.createDataFrame([(1, 10), (3, 10), (5, 20), (5, 21)], "node long, id long")
    got = {r.root: (r.id, r.status) for r in entity.stable_ids(nodes, known).collect()}
    assert got == {1: (None, "split"), 3: (None, "split"), 5: (None, "merged"), 6: (10001, "new")}
    with pytest.raises(ValueError, match="merge or split"):
        entity.stable_ids(nodes, known, abort=True)
    profiles = [(1, "J.T. Smith", "men", "A", 2000, 2001), (2, "JT Smith", "men", "B", 2001, 2002), (3, "Ann Lee", "women", "C", 2000, 2001), (4, "Ann Cruz", "women", "C", 2003, 2004), (5, "Jon Smyth", "men", "A", 1990, 1991), (6, "Jon Smith", "men", "A", 2003, 2004), (7, "Ann Lee", "women", "D", 2000, 2001)]
    df = spark.createDataFrame(profiles, "id long, name string, gender string, school string, first_year int, last_year int").withColumn("groups", F.array().cast("array<string>"))
    got = {(r.a, r.b): (r.strategy, r.recommendation) for r in entity.candidates(df).collect()}
    assert got == {(1, 2): ("initials", "same"), (3, 4): ("maiden_married", "same"), (5, 6): ("cross_fuzzy", "different_likely"), (3, 7): ("exact", "same")}


def test_numbers_and_islands(spark):
    rows = spark.createDataFrame([(None, "a"), ("b", "b"), ("b", "a"), ("z", "c"), (None, "b")], "k string, v string")
    got = [(r.row_id, r.k, r.v) for r in windows.numbered(rows, ["k", "v"]).orderBy("row_id").collect()]
    assert got == [(1, None, "a"), (2, None, "b"), (3, "b", "a"), (4, "b", "b"), (5, "z", "c")]
    assert windows.numbered(rows.filter("false"), ["k"]).count() == 0
    days = spark.createDataFrame([(x,) for x in (1, 2, 3, 7, 9, 10)], "d long")
    assert sorted((r.first, r.last) for r in windows.islands(days, "d").collect()) == [(1, 3), (7, 7), (9, 10)]


def test_lookups_do_not_multiply_rows(spark):
    rows, dim = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    assert sorted(map(tuple, joins.lookup(rows, dim, ["k"]).collect()), key=str) == [(1, "a"), (2, None)]


def test_sinks_and_readers(spark, tmp_path):
    path = f"file://{tmp_path}/new"
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    assert sinks.append_new(df, path, ["k"]) == 2 and sinks.append_new(df, path, ["k"]) == 0
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]
    sinks.write_results(df.withColumn("ok", F.lit(True)), f"{tmp_path}/results", ["k"], ["v"])
    assert [r.ok for r in spark.read.parquet(f"{tmp_path}/results").collect()] == [1, 1, 1]
    assert sinks.append_sources([df, df.drop("v")]).count() == 6 and df.select(sinks.as_json("k", "v").alias("j")).first().j == '{"k":1,"v":"a"}'
    (tmp_path / "p.json").write_text('[{"k": 1, "v": "x"}]')
    (tmp_path / "none.json").write_text("[]")
    assert readers.patches(spark, f"{tmp_path}/p.json", "k long, v string").count() == 1 and readers.patches(spark, f"{tmp_path}/none.json", "k long").count() == 0
    (tmp_path / "pairs.tsv").write_text("a\tb\n1\t2\n")
    assert tuple(readers.reviewed_pairs(spark, f"{tmp_path}/pairs.tsv").first()) == ("1", "2")
    (tmp_path / "nested.json").write_text('{"2001": {"men": {"100m": [{"name": "A", "place": 1}, {"name": "B", "place": 2}]}}}')
    assert [tuple(r) for r in readers.nested_entries(spark, f"{tmp_path}/nested.json", "struct<name:string,place:int>").collect()] == [("2001", "men", "100m", 0, "A", 1), ("2001", "men", "100m", 1, "B", 2)]
    pages = spark.createDataFrame([(1, "<table><tr><th>a<td>b &amp; c<table><tr><td>in</table></tr></table>"), (2, "none"), (3, "")], "id long, html string")
    assert [(r.id, r.table_no, r.row_no, r.cells) for r in readers.html_tables(pages, "id", "html").collect()] == [(1, 1, 0, ["in"]), (1, 0, 0, ["a", "b & c"])]
    kept = stages.kept(df)
    assert kept.count() == 3
    stages.removed(kept)


def test_aggregates(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k long, v string")
    assert {r.k: r.x for r in rows.groupBy("k").agg(aggregates.joined_set("v").alias("x")).collect()} == {1: "a,b", 2: "c"}
    assert aggregates.entity_search(rows.withColumns({"g": F.lit("m"), "y": F.lit(1)}), "k", "v", "v", "g", "y", "A").count() == 1
    assert quality.duplicates(rows, ["k"]).count() == 1
