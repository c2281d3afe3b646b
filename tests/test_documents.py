"""Whole documents and pages to results, and the grammars of their lines, on texts written by hand."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyloom.functions import lines, names, tables
from tallyloom.operators import documents, joins, page_results, windows
from tallyloom.sources import pages, readers

RELAYS = """ignored
1999
(Eugene, Ore, June 4–5)
1. Texas..... 3:01.20
   (Ann Lee 45.1, Bo Cruz' 46.2,
    Cy Dee 47.3, Di Eff 44.9)
2. LIU ..... 3:02.00+
(3:05.2 MR)
(A One, B Two, C Three, D Four)
3. Rice ..... 3:03.00

4. UCLA ..... 3:04.00
… DQ
[3]Baylor ...... [3:02.5]
(E One, F Two, G Three, H Four)
… DNF
Houston (personnel unknown)
5. Yale ..... 3:09.1
2000
Composite finish:
1. Texas ..... 3:00.00
2. Rice ...... 3:01.00
Section I:
1. Rice ..... 3:05.00
(I One, J Two, K Three, L Four)
2. Iowa ..... 3:06.00
(M One, N Two,
O Three, P Four 45.5)
2001
(June 9; windy)
1. Troy ..... 3:01.00
2. Navy ..... 3:02.00
(Q One, R Two, S Three, T Four)
"""
SINGLES = """2001
wind +1.2
(June 7)
1. Carl Lewis' (Houston) ..... So 10.00w
=2. Al Bee (Texas) ...... Jr 10.10
… DNF

Bo Cee (Rice)
… DNS
(meet not held)
...
Cy Dee (Rice)
Di Eff (Iowa)
"""


def values(spark, expression, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_documents(spark):
    docs = spark.createDataFrame([("a", RELAYS, True), ("b", SINGLES, False), ("c", None, False), ("d", "", True)], "doc string, text string, relay boolean")
    rows = readers.lines(docs.select("doc", "text"), "doc", "text").join(docs.select("doc", "relay"), "doc").repartition(3)
    got = documents.results(rows, "doc", "line_no", "line", F.col("relay"), tables.CLASSES, tables.SCHOOLS, tables.SCHOOL_SPLITS).collect()
    flags = lambda r: "".join(f for f in ("dq", "dnf", "dns") if r[f"is_{f}"])
    teams = {}
    for r in sorted((r for r in got if r.doc == "a"), key=lambda r: (r.line_no, r.leg_idx)):
        assert r.is_relay
        teams.setdefault((r.year, r.place, r.school, r.mark_str, flags(r)), []).append((r.leg_idx, r.name, r.split_time, r.is_international))
    unknown = [(i, "Relay member unknown", None, False) for i in range(1, 5)]
    four = lambda *n: [(i, x, None, False) for i, x in enumerate(n, 1)]
    assert teams == {
        (1999, 1, "Texas", "3:01.20", ""): [(1, "Ann Lee", "45.1", False), (2, "Bo Cruz", "46.2", True), (3, "Cy Dee", "47.3", False), (4, "Di Eff", "44.9", False)],
        (1999, 2, "LIU Brooklyn", "3:02.00", ""): four("A One", "B Two", "C Three", "D Four"),
        (1999, 3, "Rice", "3:03.00", ""): unknown,
        (1999, 3, "Baylor", "3:02.5", "dq"): four("E One", "F Two", "G Three", "H Four"),
        (1999, None, "Houston", None, "dnf"): unknown,
        (2000, 2, "Rice", "3:01.00", ""): four("I One", "J Two", "K Three", "L Four"),
        (2000, None, "Iowa", "3:06.00", ""): [*four("M One", "N Two", "O Three"), (4, "P Four", "45.5", False)],
        # A team without a list of its own takes the next team's line and members, as the search for them goes on.
        (2001, 1, "Troy", "3:01.00", ""): four("Q One", "R Two", "S Three", "T Four"),
    }
    where = {(r.year, r.location, r.date) for r in got if r.doc == "a"}
    assert where == {(1999, "Eugene, Ore", "June 4"), (2000, None, None), (2001, None, "June 9")}
    assert {r.school for r in got if r.is_converted} == {"LIU Brooklyn"}
    singles = [(r.place, r.name, r.school, r["class"], r.mark_num, r.is_wind_aided, r.is_international, flags(r), r.wind, r.date) for r in sorted((r for r in got if r.doc == "b"), key=lambda r: r.line_no)]
    assert singles == [
        (1, "Carl Lewis", "Houston", "sophomore", 10.0, True, True, "", 1.2, "June 7"), (2, "Al Bee", "Texas", "junior", 10.1, False, False, "", 1.2, "June 7"),
        (None, "Cy Dee", "Rice", None, None, False, False, "dns", 1.2, "June 7"),
    ]
    assert {r.doc for r in got} == {"a", "b"}


def test_a_section_s_lines_stream_through_one_task_without_being_held(spark):
    """A document of one section and 5,000 teams: nothing but lines in order, whatever their number."""
    n = 5_000
    rows = spark.range(2 * n + 1).selectExpr("'x' AS doc", "CAST(id AS INT) AS line_no", "CASE WHEN id = 0 THEN '1990' WHEN id % 2 = 1 THEN concat(1 + id DIV 2, '. Rice ..... 3:01.0') ELSE '(A B, C D, E F, G H)' END AS line")
    got = documents.results(rows, "doc", "line_no", "line", F.lit(True), tables.CLASSES, {})
    assert got.count() == 4 * n and got.agg(F.count_distinct("place")).first()[0] == n


def test_first_page_is_left_out(spark):
    rows = readers.lines(spark.createDataFrame([("h", "2025\n1. a\n2024\n\f2025\n2. b"), ("k", "2025\n1. a")], "doc string, text string"), "doc", "text")
    left = documents.without_first_page(rows, "doc", "line_no", "line", F.col("doc") == "h", 2025).orderBy("doc", "line_no").collect()
    assert [r.line for r in left] == ["2025", "\f2025", "2. b", "2025", "1. a"]


def test_members(spark):
    got = values(spark, lines.members, "José Núñez 48.3", "Ann Lee c48.3", "Ann Lee48.31", "Ann, Lee 48.3, Bo B 47.1, Cy C 46.1, Di D 45.1", "Ann Lee', Bo; pulled, Cy", "Ann’ 1:50.1 y, Bo*.", "A B' C D, E F, G H", "Ann [fell] Bo", None)
    plain = [None if v is None else [(m.leg_idx, m.name, m.split_time, m.is_international) for m in v] for v in got]
    assert plain == [
        [(1, "José Núñez", "48.3", False)], [(1, "Ann Lee", "48.3", False)], [(1, "Ann Lee", "48.31", False)],
        [(1, "Ann Lee", "48.3", False), (2, "Bo B", "47.1", False), (3, "Cy C", "46.1", False), (4, "Di D", "45.1", False)],
        [(1, "Ann Lee", None, True), (3, "Cy", None, False)], [(1, "Ann", "1:50.1 ", True), (2, "Bo*.", None, False)],
        [(1, "A B", None, False), (2, "C D", None, False), (3, "E F", None, False), (4, "G H", None, False)], [(1, "Ann", None, False), (2, "Bo", None, False)], None,
    ]


def test_indoor_members(spark):
    got = values(spark, lambda t: lines.indoor_members(t, tables.CLASSES), "Jo LEE, Jr. (SO) 46.91, Al O'NEIL 1:52.10 (JR), Bo McCOY-DAY (XX)", "then-WB, CR -- Ann ABC, Bo DEF -- short course", "questionable course length", "hc(Ann Bee, Cy Dee)", "", None)
    plain = [[(m.leg_idx, m.name, m.split_time, m["class"]) for m in v] for v in got]
    assert plain == [
        [(1, "Jo Lee, Jr.", "46.91", "sophomore"), (2, "Al O'Neil", "1:52.10", "junior"), (3, "Bo Mccoy-Day", None, None)], [(1, "Ann Abc", None, None), (2, "Bo Def", None, None)], [],
        [(1, "Ann Bee", None, None), (2, "Cy Dee", None, None)], [], [],
    ]


def test_classifiers(spark):
    got = values(spark, lines.member_line, "(Ann, Bo)", "  (Ann,", "(1 contestants)", "(?)", "()", "   Ann Lee, Bo", "   Ann 45.2)", "   12", "1. Rice", "[3]Rice (x)", "(12.5y MR)")
    assert [tuple(v) for v in got] == [("Ann, Bo", True), ("Ann,", False), (None, True), (None, True), (None, True), ("Ann Lee, Bo", False), ("Ann 45.2", True), (None, False), (None, False), (None, False), (None, True)]
    assert values(spark, lines.is_note, "* = heat", " ¶ = x", "(low-altitude 10.1)", "(officially 3rd)", "(the time officially 3rd)", "(note: x)", "(Ann, Bo)", "but its three leading runners") == [True] * 6 + [False, True]
    assert values(spark, lines.status_word, "… dnf: Ann", "... DQ", "...DNC", "... x", "DNF") == ["dnf", "dq", "dns", None, None]
    got = values(spark, lambda t: lines.athlete_status(t, {"Tex": "Texas"}), "Ann Lee' (Tex)", ".. Bo (Rice) (injured)", "Rice (personnel unknown)", "ann (Rice)", "Ann Lee")
    assert [None if v is None else (v.name, v.school, v.is_international, v.unknown_team) for v in got] == [("Ann Lee", "Texas", True, False), ("Bo", "Rice", False, False), (None, "Rice", False, True), None, None]
    got = values(spark, lines.header_parts, "2025 * Virginia Beach, Va. * Saturday, March 15", "2025", "Rome*1999 * x")
    assert [tuple(v) for v in got] == [(2025, "Virginia Beach, Va.", "Saturday, March 15"), (2025, None, None), (1999, "x", None)]
    assert values(spark, lines.meet_date, "(June 7 something", "(June 7)", "(June 7–9; x", "(Eugene, Ore, June 7 x", "(Austin; July 1") == [None, "June 7", "June 7", "June 7", "July 1"]


def test_classes_and_schools(spark):
    assert values(spark, lambda t: names.parse_class(t, tables.CLASSES), "Jfr", " St ", "S0", "so", "xJrx", "", None) == ["junior", "senior", "sophomore", "sophomore", "junior", None, None]
    df = spark.createDataFrame([("LIU", None), ("LIU", 2018), ("LIU", 2019), ("UT Pan American*", 2015), ("UTRGV", 2016), (" VCU ....", 2000)], "s string, y int")
    assert [r.v for r in df.select(names.clean_school(F.col("s"), tables.SCHOOLS, F.col("y"), tables.SCHOOL_SPLITS).alias("v")).collect()] == ["LIU Brooklyn", "LIU Brooklyn", "LIU", "UT-Pan American", "UT-Rio Grande Valley", "Virginia Commonwealth"]
    assert values(spark, names.cased, "Jordan ANTHONY", "ANN DE LA CRUZ?", "Jo McDonald", "Jo SMITH III", None) == ["Jordan Anthony", "ANN De La Cruz", "Jo McDonald", "Jo Smith III", None]


def test_listed_pages(spark):
    row = lambda place, name, school, mark: f"<tr><td>({place}) {name}</td><td></td><td>{school}</td><td>{mark}</td></tr>"
    track = "<table><tr><td colspan=2>1994 * Rome * Friday, March 1</td></tr><tr><td><table>" + row(1, "<b>Ann LEEJR</b>", " Rice ", "7.11c") + row(2, "Bo", "(None)", "7.2") + row(999, "Cy", "Iowa", "7.3") + row(999, "Di", "Iowa", "") + row(1, "Ann LEE JR", "Rice", "7.11c")
    track += "<tr><td>3</td><td></td><td>x</td><td>7</td></tr></table></td></tr></table><table><tr><td colspan='2'>1995 * Oslo</td></tr><tr><td><table>" + row(0, "Ed", "Yale", "7.4") + "</table></td></tr></table>"
    relay = "<table><tr><td colspan=4>1994 * Rome</td></tr><tr><td><table>" + row(1, "Rice", "", "3:05.1") + "<tr><td colspan=4>A BEE, C DEE (SO) 46.1</td></tr>" + row(2, "Iowa", "", "3:06") + row(3, "Yale", "", "3:07") + "<tr><td>no</td></tr></table></td></tr></table>"
    files = [("outdoor_women_1.html", track), ("men_19.html", relay), ("women_63.html", relay), ("men_77.html", track), ("readme.txt", track), ("men_1.html", None), ("a_b_c.html", track)]
    df = spark.createDataFrame(files, "file_name string, html string")
    skip = (F.col("code") == "63") & (F.col("gender") == "women") & (F.col("year") == 1994)
    got = page_results.listed_results(df, pages.file_facts(F.col("file_name")), "html", tables.EVENT_CODES, tables.CLASSES, tables.SCHOOLS, tables.SCHOOL_SPLITS, 50, skip).collect()
    single = {(r.year, r.location, r.date, r.place, r.name, r.school, r["class"], r.mark_num, r.is_dq, r.is_dnf, r.is_converted, r.environment) for r in got if not r.is_relay}
    assert single == {
        (1994, "Rome", "Friday, March 1", 1, "Ann Lee", "Rice", "junior", 7.11, False, False, True, "outdoor"), (1994, "Rome", "Friday, March 1", 999, "Cy", "Iowa", None, 7.3, True, False, False, "outdoor"),
        (1994, "Rome", "Friday, March 1", 999, "Di", "Iowa", None, None, False, True, False, "outdoor"), (1995, "Oslo", None, None, "Ed", "Yale", None, 7.4, False, True, False, "outdoor"),
    }
    assert len([r for r in got if not r.is_relay]) == 4
    relays = sorted((r.school, r.leg_idx, r.name, r["class"], r.split_time) for r in got if r.is_relay)
    unknown = [(s, i, "Relay member unknown", None, None) for s in ("Iowa", "Yale") for i in range(1, 5)]
    assert relays == sorted([("Rice", 1, "A Bee", None, None), ("Rice", 2, "C Dee", "sophomore", "46.1"), *unknown])
    above = spark.createDataFrame([("men_1.html", "<table>" + row(1, "Ann", "Rice", "7") + "</table>")], "file_name string, html string")
    with pytest.raises(PySparkException, match="above all headers"):
        page_results.listed_results(above, pages.file_facts(F.col("file_name")), "html", tables.EVENT_CODES, tables.CLASSES, {}, least_length=0).collect()


def test_pages_are_read_from_a_folder(spark, tmp_path):
    for name in ("men_19.html", "outdoor_women_34.html", "x.txt"):
        (tmp_path / name).write_text("<p>é</p>\n<b>two lines</b>")
    got = pages.read_pages(spark, str(tmp_path)).select("file_name", pages.file_facts(F.col("file_name")).alias("f"), "html").orderBy("file_name").collect()
    assert [(r.file_name, tuple(r.f), r.html) for r in got] == [("men_19.html", ("indoor", "men", "19"), "<p>é</p>\n<b>two lines</b>"), ("outdoor_women_34.html", ("outdoor", "women", "34"), "<p>é</p>\n<b>two lines</b>")]


def test_tabled_pages_by_first_splits_and_last_athletes(spark):
    compiled = "<a href='7-2.htm'>2</a><a class=x href=\"7-1.htm\">1</a><a href='7-1.htm?x'>no</a><table id=events><tbody><tr><td>1</td><td></td><td><small>Rice</small></td><td>3:01.5 PB</td></tr><tr><td>9</td><td></td><td><small>Iowa</small></td><td>3:02</td></tr><tr><td>DQ</td><td></td><td></td><td></td></tr></tbody></table>"
    section = lambda t, names: f"<table id=splits><tr><td>1</td><td></td><td></td><td><small>Rice</small></td><td></td><td>50 [{t}]</td><td>1:40</td><td>2:30 [49.9]</td></tr><tr><td>DQ</td><td></td><td></td><td><small>Rice</small></td><td></td><td>[9]</td></tr></table><table><thead class=thead-dark><tr><th>Team</th><th>Athletes</th></tr></thead><tbody><tr><td>Rice</td><td>{names}</td></tr></tbody></table>"
    df = spark.createDataFrame([("7_compiled.htm", compiled), ("7-1.htm", section("45.1", "A ABC")), ("7-2.htm", section("46.1", "B ABC, , C DEF, D GHI")), ("8-1.htm", section("1", "X"))], "file_name string, html string")
    events = spark.createDataFrame([("7_compiled.htm", "7", "DMR", "men", "relay")], "file_name string, code string, discipline string, gender string, kind string")
    got = page_results.tabled_results(df, events, 2026, "Rome", "indoor", {"Friday": "x"}, tables.CLASSES, tables.SCHOOLS).collect()
    assert sorted((r.leg_idx, r.name, r.split_time, r.mark_num, r.school, r.place, r.date) for r in got) == [(1, "B Abc", "45.1", 181.5, "Rice", 1, None), (2, "C Def", "49.9", 181.5, "Rice", 1, None), (3, "D Ghi", None, 181.5, "Rice", 1, None)]


def test_zip_inherit_pad_and_look_ahead(spark):
    left = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["c"])], "k int, items array<string>")
    other = spark.createDataFrame([(1, [10]), (2, [1, 2, 3, 4, 5]), (4, [7, 8])], "k int, values array<int>")
    got = sorted((r.k, r.position, r.item, r.value) for r in joins.zipped(left, other, ["k"], "items", "values", "item", "value", 2).collect())
    assert got == [(1, 1, "a", 10), (1, 2, "b", None), (2, 1, None, 1), (2, 2, None, 2), (3, 1, None, None), (3, 2, None, None), (4, 1, "c", 7)]
    rows = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0), (None, 3, 3.0)], "s string, place int, mark double")
    listing = spark.createDataFrame([("a", 9, None)], "s string, place int, mark double")
    assert sorted(map(tuple, joins.inherited(rows, listing, ["s"], ["place", "mark"], ["place"]).collect()), key=str) == sorted([("a", 9, None), ("b", None, 2.0), (None, None, 3.0)], key=str)
    assert sorted(r.slot or 0 for r in windows.padded(spark.createDataFrame([(2,), (0,), (None,)], "n int"), F.col("n"), "slot").collect()) == [0, 0, 1, 2]
    runs = spark.createDataFrame([("g", i, k) for i, k in enumerate("TTTxTvx")] + [("h", 0, "T")], "g string, i int, k string")
    got = windows.with_next_row(runs, ["g"], ["i"], F.col("k") == "T", F.when(F.col("k") != "v", F.col("i")), "taken").collect()
    assert sorted((r.g, r.i, r.taken) for r in got) == [("g", 0, 1), ("g", 2, 3), ("g", 4, None), ("g", 5, None), ("g", 6, None), ("h", 0, None)]


def test_plain_pages_are_scanned_as_the_parser_reads_them():
    """Random pieces of markup, odd ones among them: the plain scan and HTMLParser give the same tables."""
    pieces = ["<table>", "<table id=events>", "<TABLE ID='s p' id=\"b\">", "</table>", "<tr>", "</tr >", "<td>", "<td colspan=2>", "<td colspan>", "</td>", "<th>", "<thead class=\"a b\">", "<tbody>", "</tbody>", "<b>", "</b>", "<small>", "</small>"]
    pieces += ["<a class='openStats' href=\"x\">", "</a>", "<br>", "<br/>", "<hr />", "1994 * Rome", " a ", "\n", " ", "x&amp;y", "&nbsp;", "&", "é"]
    odd = ["<!-- <td> -->", "<script>if (a<b) {'<td>'}</script>", "a < b", "<td x=\"a>b\">", "<td a=1 / b>", "</td x>", "<a href='a&amp;b'>", "<!DOCTYPE html>", "<td id=''>", "<td a = 1>", "<title><td></title>", "<td\x0bx>", "<"]
    chosen, plain = random.Random(5), 0
    for n in range(3000):
        html = "<table>" + "".join(chosen.choice(pieces + odd * (n % 2)) for _ in range(chosen.randint(0, 30)))
        slow = pages._Cells()
        slow.feed(html)
        slow.close()
        fast = pages._Cells()
        plain += pages._fed_plainly(fast, html)
        assert pages.page_tables(html) == slow.finish(), html
    assert plain > 1400


def test_links_stay_with_a_pages_first_row(spark):
    """What is kept of pages holds their links once and none of their text."""
    df = spark.createDataFrame([("p", "<table></table><table><tr><td>a</td></tr><tr></tr></table><table><tr><td>b</td></tr></table>"), ("q", "<p>no table</p>"), ("r", None)], "f string, html string")
    got = pages.cell_rows(df.withColumn("links", F.array("f")), "html", ["f", "links"]).select("f", "links", "table_no", "row_no", "page_row", F.size("cells").alias("n")).collect()
    assert sorted(map(tuple, got)) == [("p", ["p"], 1, 0, 0, 1), ("p", ["p"], 1, 1, 1, 0), ("p", ["p"], 2, 0, 2, 1)]
