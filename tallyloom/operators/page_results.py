"""Result pages to typed result rows: lists under headers, and tables by their identifiers.

Both dialects end in the same columns. Rows, cells and headers come from sources/pages.py; what they mean is said here by
column expressions, windows (the header above a table, the row of members behind a team's) and joins (event codes, splits
and athletes of a team from other pages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import lines, marks, names
from tallyloom.functions.marks import let
from tallyloom.functions.tables import NO_SCHOOL
from tallyloom.operators.joins import zipped
from tallyloom.operators.stages import kept
from tallyloom.operators.windows import first_wins, with_next_row
from tallyloom.sources.pages import cell_rows, marked_text, page_links

UNKNOWN_MEMBER, TEAM = "Relay member unknown", 4
#: What makes two rows of a source the same result.
RESULT_KEY = ["name", "school", "place", "discipline", "gender", "year", "environment", "leg_idx"]
COLUMNS = ["year", "date", "location", "environment", "gender", "discipline", "name", "school", "class", "place", "mark_num", "mark_str", "is_dq", "is_dnf", "is_dns", "is_relay", "leg_idx", "split_time", "is_converted"]


def event_table(df: DataFrame, codes: dict[str, tuple[str, str]]) -> DataFrame:
    """(code, discipline, kind): the event and its kind of each source code."""
    return df.sparkSession.createDataFrame([(c, *e) for c, e in codes.items()], "code string, discipline string, kind string")


def listed_results(pages: DataFrame, facts: Column, html: str, codes: dict[str, tuple[str, str]], classes: dict[str, str], schools: dict[str, str], splits: list[tuple] = (), least_length: int = 28_000, skip: Column | None = None) -> DataFrame:
    """Results of pages whose lists stand under ``YYYY * place * Weekday, Month d`` headers.

    facts is a struct (environment, gender, code) of each page; pages without one, of unknown codes, and shorter ones
    than ``least_length`` (blank pages) give no rows. A table takes the last header of the latest outer table before
    it. A team's members are in the row behind it if that is one wide cell; a team without them has four unknown
    ones. Rows that ``skip`` picks go, then all but the first of equal results of a page. A row above all headers
    fails the job.
    """
    known = pages.select(facts.alias("_facts"), F.col(html).alias("_html")).filter("_facts IS NOT NULL").select("_facts.*", "_html", F.monotonically_increasing_id().alias("_page"))
    known = known.join(F.broadcast(event_table(pages, codes)), "code")
    page = ["_page", "environment", "gender", "code", "discipline", "kind"]
    # Written, so that pages are parsed once and keep their numbers: of the cells no more than the columns below.
    first = F.get("cells", F.lit(0))
    text = lambda n: F.get("cells", F.lit(n))["text"]
    rows = cell_rows(known, "_html", page, least_length)
    rows = kept(rows.select(*page, "table_no", "row_no", "nested", "header", F.size("cells").alias("_n"), first["wide"].alias("_wide"), first["text"].alias("_first"), F.when(F.col("kind") != "relay", text(2)).alias("_third"), text(3).alias("_fourth")))
    own = Window.partitionBy("_page").orderBy("table_no", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_header", F.last(F.when(F.col("nested"), F.col("header")), ignorenulls=True).over(own)).filter("NOT nested")
    member_row = F.when((F.col("_n") == 1) & F.col("_wide"), F.col("_first"))
    is_entry = (F.col("_n") >= 4) & F.col("_first").rlike(r"^\(\d+\)\s*.")
    rows = with_next_row(rows, ["_page", "table_no"], ["row_no"], is_entry & (F.col("kind") == "relay"), member_row, "_members").filter(is_entry)
    mark, named = F.col("_fourth"), F.regexp_extract("_first", r"^\(\d+\)\s*(.+)", 1)
    head, place, is_relay = lines.header_parts(F.col("_header")), marks.parse_place(F.col("_first")), F.col("kind") == "relay"
    rows = rows.withColumns({"_head": head, "_place": place, "_mark": marks.parse_indoor_mark(mark, F.col("kind")), "_late": marks.sentinel_status(place["place"], mark), "_named": named, "is_relay": is_relay})
    year = F.coalesce("_head.year", F.raise_error(F.lit("a result above all headers")).cast("int"))
    school = names.clean_school(F.when(is_relay, F.col("_named")).otherwise(F.col("_third")), schools, F.col("year"), splits)
    rows = rows.withColumn("year", year).withColumn("school", school).filter(is_relay | ~F.col("school").isin(*NO_SCHOOL))
    is_status = lambda s: F.coalesce((F.col("_place.status") == s) | (F.col("_late") == s), F.lit(False))
    rows = rows.withColumns({"date": F.col("_head.date"), "location": F.col("_head.location"), "place": F.col("_place.place"), "mark_num": F.col("_mark.num"), "mark_str": F.col("_mark.cleaned"), "is_converted": F.col("_mark.converted")})
    rows = rows.withColumns({f"is_{s.lower()}": is_status(s) for s in ("DQ", "DNF", "DNS")})
    one = names.name_and_class(F.col("_named"), {c: classes[c] for c in ("SR", "JR", "SO", "FR")})
    # The legs of a row as an array, so that all kinds of rows go one way and none is sorted twice.
    leg = lambda name, code, i, time: F.struct(name.alias("name"), code.alias("class"), i.cast("int").alias("leg_idx"), time.cast("string").alias("split_time"))
    none = F.lit(None)
    unknown = F.array(*[leg(F.lit(UNKNOWN_MEMBER), none.cast("string"), F.lit(i), none) for i in range(1, TEAM + 1)])
    team = let(lines.indoor_members(F.coalesce("_members", F.lit("")), classes), lambda m: F.when(F.size(m) > 0, F.transform(m, lambda x: leg(x["name"], x["class"], x["leg_idx"], x["split_time"]))).otherwise(unknown))
    single = let(one, lambda x: F.array(leg(names.cased(x["name"]), x["class"], none, none)))
    rows = rows.withColumn("_leg", F.explode(F.when(is_relay, team).otherwise(single)))
    order = ["_page", "table_no", "row_no"]
    out = rows.withColumns({c: F.col(f"_leg.{c}") for c in ("name", "class", "leg_idx", "split_time")}).select(*order, "code", *COLUMNS)
    if skip is not None:
        out = out.filter(~F.coalesce(skip, F.lit(False)))
    return first_wins(out, ["_page", *RESULT_KEY], [F.col(c) for c in order]).select(*COLUMNS)


def _placed_rows(rows: DataFrame, table: str, most: int) -> DataFrame:
    """Rows of a table's body with four cells and a whole place of ``most`` at most."""
    place = F.col("first").try_cast("int")
    return rows.filter((F.col("table_id") == table) & (F.col("part") == "tbody") & (F.col("n_cells") >= 4)).withColumn("place", place).filter(F.col("place") <= most)


def _small(cell: Column) -> Column:
    return names.stripped(F.replace(F.coalesce(marked_text(cell, "small"), F.lit("")), F.lit("\u00a0"), F.lit(" ")))


def _athlete(name: Column, small: Column, classes: dict[str, str]) -> dict[str, Column]:
    """Name, school and class of an athlete's cell: a link or bold text, then ``School [CLASS]`` in small print."""
    form = r"^(.+?)\s*\[([A-Z]+)\]"
    code = F.regexp_extract(small, form, 2)
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in classes.items() for x in pair]), code)
    return {"name": names.cased(name), "school": F.when(small.rlike(form), F.regexp_extract(small, form, 1)).otherwise(small), "class": F.when(small.rlike(form), known)}


def tabled_results(pages: DataFrame, events: DataFrame, year: int, location: str, environment: str, days: dict[str, str], classes: dict[str, str], schools: dict[str, str], splits: list[tuple] = (), most_place: int = 8) -> DataFrame:
    """Results of pages whose tables are known by identifiers: events, multitotalscores, splits, headerevent.

    pages is (file_name, html), events (file_name, code, discipline, gender, kind) of the compiled pages; pages without
    an event are sections of relays, which compiled pages link to as ``code-N.htm``. A relay's members and split times
    stand there: of a team's splits those of the first page count, of its members those of the last; members meet
    their times by position, and a team without members has four unknown ones. Nulls as no such page.
    """
    lit_year = F.lit(year)
    # Missing cells of short rows are null, so that rows of other tables do no harm. Pages are read and parsed once, and
    # meet their events before that; a page's links stay with its first row. What is written is flat and holds no page.
    facts = [c for c in events.columns if c != "file_name"]
    cell = lambda n: F.get("cells", F.lit(n))
    whole = F.array_join(F.transform("cells", lambda c: c["text"]), "")
    day = F.coalesce(*[F.when(whole.contains(d), F.lit(date)) for d, date in days.items()])
    bracket = lambda c: F.nullif(F.regexp_extract(F.array_join(F.transform(c["parts"], lambda p: p["text"]), " "), r"\[([^\]]+)\]", 1), F.lit(""))
    linked = F.when(F.col("kind") == "relay", page_links(F.col("html"), F.concat(F.col("code"), F.lit(r"-\d+\.htm"))))
    rows = cell_rows(pages.join(events, "file_name", "left").withColumn("links", linked), "html", ["file_name", *facts, "links"])
    has, is_body = lambda *ids: F.coalesce(F.col("table_id").isin(*ids), F.lit(False)), F.coalesce(F.col("part") == "tbody", F.lit(False))
    is_entry, is_split = has("events", "multitotalscores") & is_body & (F.size("cells") >= 4), has("splits") & (F.size("cells") >= 6) & ~cell(0)["text"].isin("", "DQ")
    is_head = F.coalesce((F.col("part") == "thead") & F.col("part_kind").contains("thead-dark") & (cell(0)["text"] == "Team") & (cell(1)["text"] == "Athletes"), F.lit(False))
    rows = kept(rows.select(
        "file_name", *facts, "table_no", "table_id", "row_no", "part", F.size("cells").alias("n_cells"), F.when(F.col("page_row") == 0, F.col("links")).alias("links"), is_split.alias("is_split"), is_head.alias("is_head"),
        cell(0)["text"].alias("first"), F.when(is_body, cell(1)["text"]).alias("second"), F.when(is_entry, F.coalesce(marked_text(cell(2), "a", "openStats"), marked_text(cell(2), "b"), F.lit(""))).alias("named"),
        F.when(is_entry, _small(cell(2))).when(is_split, _small(cell(3))).alias("small"), F.when(is_entry, cell(3)["text"]).alias("mark"),
        F.when(is_split, F.array_compact(F.transform(F.slice("cells", 6, 4), bracket))).alias("times"), F.when(has("headerevent"), day).alias("day"),
    ))
    dates = rows.filter("day IS NOT NULL").groupBy("file_name").agg(F.min_by("day", F.struct("row_no", "table_no")).alias("date"))
    mark = F.col("mark")
    number = {"track": F.coalesce(F.nullif(F.regexp_extract(mark, r"^([\d:.]+)", 1), F.lit("")), mark), "field": F.nullif(F.regexp_extract(mark, r"^([\d.]+m)", 1), F.lit("")), "multi": F.nullif(F.regexp_extract(mark, r"^(\d+)", 1), F.lit(""))}
    value = {"track": marks.seconds(number["track"]), "field": marks.to_number(F.regexp_extract(number["field"], r"^([\d.]+)m", 1)), "multi": number["multi"].try_cast("double")}
    kind = F.col("kind")
    by_kind = lambda of: F.when(kind == "field", of["field"]).when(kind == "multi", of["multi"]).otherwise(of["track"])
    entries = _placed_rows(rows.filter("kind <> 'multi'"), "events", most_place).unionByName(_placed_rows(rows.filter("kind = 'multi'"), "multitotalscores", most_place))
    entries = entries.withColumns({"mark_str": by_kind(number), "mark_num": by_kind(value)}).filter("kind NOT IN ('field', 'multi') OR mark_str IS NOT NULL")
    clean = lambda school: names.clean_school(school, schools, lit_year, splits)
    none = lambda t: F.lit(None).cast(t)
    own = _athlete(F.col("named"), F.col("small"), classes)
    single = entries.filter("kind <> 'relay'").withColumns(own | {"school": clean(own["school"]), "leg_idx": none("int"), "split_time": none("string")})
    last = Window.partitionBy("file_name", "school").orderBy(F.col("row_no").desc())
    team = entries.filter("kind = 'relay'").withColumn("school", clean(F.col("small"))).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "times")
    links = rows.filter("links IS NOT NULL").select("file_name", F.explode("links").alias("section_page"))
    sections = rows.drop(*facts, "links").withColumnRenamed("file_name", "section_page").join(links, "section_page")
    times = sections.filter("is_split").select("file_name", "section_page", "row_no", clean(F.col("small")).alias("school"), "times")
    times = times.groupBy("file_name", "school").agg(F.min_by("times", F.struct("section_page", "row_no")).alias("times"))
    listed = sections.filter("part = 'tbody' AND n_cells >= 2").join(sections.filter("is_head").select("file_name", "section_page", "table_no").distinct(), ["file_name", "section_page", "table_no"])
    people = F.transform(F.filter(F.transform(F.split("second", ","), names.stripped), lambda x: x != ""), names.cased)
    listed = listed.select("file_name", clean(F.col("first")).alias("school"), people.alias("people"), F.struct("section_page", "table_no", "row_no").alias("_at"))
    listed = listed.groupBy("file_name", "school").agg(F.max_by("people", "_at").alias("people"))
    key = ["file_name", "school"]
    legs = zipped(team.join(listed, key, "left"), times, key, "people", "times", "name", "split_time", TEAM)
    legs = legs.withColumns({"name": F.coalesce("name", F.lit(UNKNOWN_MEMBER)), "leg_idx": F.col("position").cast("int"), "class": none("string")})
    columns = ["file_name", "discipline", "gender", "kind", "name", "school", "class", "place", "mark_num", "mark_str", "leg_idx", "split_time"]
    out = single.select(*columns).unionByName(legs.select(*columns)).join(dates, "file_name", "left")
    flags = {f"is_{f}": F.lit(False) for f in ("dq", "dnf", "dns", "converted")}
    return out.withColumns(flags | {"is_relay": kind == "relay", "year": lit_year, "location": F.lit(location), "environment": F.lit(environment)}).select("file_name", *COLUMNS)
