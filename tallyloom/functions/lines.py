"""Lines of results in text documents as column expressions: results, relays, status lines, team members, context."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import marks, names

#: Words of a remark, words beside a mark that are none, and months of a meet.
REMARKS = ("died", "injured", "injury", "illness", "sick", " deceased")
BESIDE_MARK = ("MR", "CR", "WR", "WJR", "AJR", "AmCR", "(MR)", "(CR)", "(WR)", "(A)", "*", "¶", "HS", "in")
MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: Everything up to a text's last group in parentheses, the group, and the rest.
LAST_GROUP = r"^((?:[^(]*\([^)]+\))*[^(]*)\(([^)]+)\)((?:(?!\([^)]+\)).)*)$"
#: A school that is opened by a parenthesis and ended by dots instead.
OPEN_GROUP = r"^(.*?)\(([A-Za-z][A-Za-z\s&'\-./]+?)\s*\.{2,}(.*)$"


def part(text: Column, pattern: str, k: int) -> Column:
    """Group k of the pattern; null where the text doesn't match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k))


def grouped(text: Column) -> Column:
    """Struct (head, group, tail) of the text's last group in parentheses that is no remark; null without a group.

    A remark without a group before it counts as one.
    """
    of = lambda x: F.when(x.rlike(LAST_GROUP), F.struct(*[F.regexp_extract(x, LAST_GROUP, k).alias(n) for k, n in ((1, "head"), (2, "group"), (3, "tail"))]))

    def before(g: Column) -> Column:
        remark = F.lit(False)
        for word in REMARKS:
            remark = remark | F.lower(g["group"]).contains(word)
        first = lambda e: F.when(e.isNotNull(), F.struct(e["head"].alias("head"), e["group"].alias("group"), g["tail"].alias("tail"))).otherwise(g)
        return F.when(remark, marks.let(of(g["head"]), first)).otherwise(g)

    return marks.let(marks.let(text, of), before)


def placed(line: Column) -> Column:
    """Struct (place, rest, converted): ``[=][+]N. rest``; nulls for other lines. A tie has the place that it names."""
    line = F.trim(F.regexp_replace(F.trim(line), r"^=", ""))
    of = lambda text, converted: F.struct(part(text, r"^(\d+)[.,]\s*(.*)$", 1).try_cast("int").alias("place"), part(text, r"^(\d+)[.,]\s*(.*)$", 2).alias("rest"), converted.alias("converted"))
    return marks.let(line, lambda x: marks.let(F.trim(F.regexp_replace(x, r"^\++", "")), lambda text: of(text, x.startswith("+"))))


def individual(text: Column, classes: dict[str, str], schools: dict[str, str]) -> Column:
    """Struct (name, school, class, mark_num, mark_str, wind_aided, international, converted) of ``Name (School) ... Class Mark``.

    A last group in parentheses that is a remark is skipped; null where no school is found.
    """
    opened = lambda x: F.when(x.rlike(OPEN_GROUP), F.struct(*[F.regexp_extract(x, OPEN_GROUP, k).alias(n) for k, n in ((1, "head"), (2, "group"), (3, "tail"))]))
    class_of = lambda x: names.parse_class(x, classes)

    def mark_of(free: Column) -> Column:
        likely = F.filter(free, lambda x: ~x.isin(*BESIDE_MARK) & ~x.rlike("^['’][0-9]{2}$"))
        return marks.let(F.coalesce(F.get(likely, F.lit(0)), F.try_element_at(free, F.lit(-1))), marks.parse_mark)

    def named(name: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, "['’]+$", "")), r"^\*+|\*+$", ""))
        return F.struct(bare.alias("name"), name.rlike("['’]$").alias("foreign"))

    def worded(words: Column) -> Column:
        classed = F.filter(F.transform(words, lambda w: w["class"]), lambda x: x.isNotNull())
        free = F.transform(F.filter(words, lambda w: w["class"].isNull()), lambda w: w["word"])
        return F.struct(F.try_element_at(classed, F.lit(-1)).alias("class"), marks.let(free, mark_of).alias("mark"))

    def found(g: Column) -> Column:
        words = F.filter(F.split(F.regexp_replace(g["tail"], r"^\.+", ""), r"\.{2,}|\s+"), lambda x: x != "")
        words = F.transform(words, lambda x: F.struct(x.alias("word"), class_of(x).alias("class")))
        parts = F.struct(marks.let(F.trim(g["head"]), named).alias("n"), marks.let(words, worded).alias("w"))
        return marks.let(parts, lambda p: F.struct(
            p["n"]["name"].alias("name"), names.clean_school(g["group"], schools).alias("school"), p["w"]["class"].alias("class"), p["w"]["mark"]["num"].alias("mark_num"), p["w"]["mark"]["cleaned"].alias("mark_str"),
            p["w"]["mark"]["wind_aided"].alias("wind_aided"), p["n"]["foreign"].alias("international"), p["w"]["mark"]["converted"].alias("converted"),
        ))

    of = lambda x: marks.let(F.coalesce(grouped(x), opened(x)), lambda g: F.when(g.isNotNull(), found(g)))
    return marks.let(text, of)


#: How a relay's mark follows its school: after dots, after a space, or glued to it.
RELAY_FORMS = (r"^(.+?)\s*\.{2,}\s*(\S+)", r"(?i)^(.+?)\s+(\d+:\d+\.?\d*[+]?\s*|\d+\.?\d*[+w]?|DQ|DNF|DNS)$", r"^(.+?)(\d+:\d+\.?\d*[+]?)$")


def relay(text: Column, schools: dict[str, str]) -> Column:
    """Struct (school, mark_num, mark_str, wind_aided, converted, is_dq, is_dnf) of a relay line after its place."""
    formed = lambda x: F.coalesce(*[F.when(x.rlike(form), F.struct(F.regexp_extract(x, form, 1).alias("school"), F.regexp_extract(x, form, 2).alias("mark"))) for form in RELAY_FORMS], F.struct(x.alias("school"), F.lit(None).cast("string").alias("mark")))

    def found(p: Column) -> Column:
        has = lambda word: F.coalesce(F.lower(p["raw"]).contains(word), F.lit(False))
        return F.struct(
            p["school"].alias("school"), p["parsed"]["num"].alias("mark_num"), p["parsed"]["cleaned"].alias("mark_str"),
            p["parsed"]["wind_aided"].alias("wind_aided"), p["parsed"]["converted"].alias("converted"), has("dq").alias("is_dq"), has("dnf").alias("is_dnf"),
        )

    parts = lambda f: marks.let(F.trim(f["mark"]), lambda mark: F.struct(names.clean_school(f["school"], schools).alias("school"), mark.alias("raw"), marks.parse_mark(mark).alias("parsed")))
    return marks.let(text, lambda x: marks.let(formed(x), lambda f: marks.let(parts(f), found)))


#: Status lines of relays, the first that matches: (pattern, group of the old place, of the school, of the mark).
STATUS_FORMS = (
    (r"^\[(\d+)\](.+?)\s*\.{2,}\s*\[([^\]]+)\]", 1, 2, 3),
    (r"^\[(\d+)\](.+?)\s*\[([^\]]+)\]\s*\.{2,}", 1, 2, 3),
    (r"^([A-Za-z][A-Za-z\s&'\-./]+?)\s*\[([^\]]+)\]\s*\.{2,}", None, 1, 2),
    (r"^([A-Za-z][A-Za-z\s&'\-]+?)\s*\.{2,}\s*$", None, 1, None),
    (r"(?i)^([A-Za-z][A-Za-z\s&'\-]+?)\s*\(personnel unknown\)\.?\s*$", None, 1, None),
)


def relay_status(line: Column, schools: dict[str, str]) -> Column:
    """Struct (school, mark_num, mark_str, original_place) of a disqualified or unfinished relay; null for other lines."""
    line, out = F.trim(line), F.lit(None)
    for pattern, place, school, mark in reversed(STATUS_FORMS):
        parsed = marks.let(F.trim(F.regexp_extract(line, pattern, mark)) if mark else F.lit(None).cast("string"), marks.parse_mark)
        own = F.regexp_extract(line, pattern, place).try_cast("int") if place else F.lit(None).cast("int")
        found = F.struct(names.clean_school(F.trim(F.regexp_extract(line, pattern, school)), schools).alias("school"), parsed["num"].alias("mark_num"), parsed["cleaned"].alias("mark_str"), own.alias("original_place"))
        out = F.when(line.rlike(pattern), found).otherwise(out)
    # All forms hold one of these.
    return F.when(line.contains("[") | line.contains("..") | F.lower(line).contains("(personnel unknown)"), out)


#: A member and the time of a split, the first form that matches; ``y`` marks yards.
MEMBER_FORMS = (
    r"(?U)^(\w[\w\s'\-.]+?)\s+(\d+:\d+\.?\d*(?:\s*y)?)$",
    r"(?U)^(\w[\w\s'\-.]+?)\s+(\d+\.?\d*(?:\s*y)?)$",
    r"(?U)^(\w[\w\s'\-.]+?)'?\s+c?(\d+\.?\d*)$",
    r"(?U)^(\w[\w\s'\-.]+?)(\d{2}\.\d+)$",
)


def _resplit(parts: Column, pattern: str) -> Column:
    return F.flatten(F.transform(parts, lambda x: F.split(x, pattern)))


def _four_of_five(parts: Column) -> Column:
    """Of five parts, the first of the leading four without a digit is joined to the next one."""
    bare = F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: ~F.element_at(parts, i).rlike(r"(?U)\d"))
    merged = lambda at: F.concat(F.regexp_replace(F.element_at(parts, at), ",", ""), F.lit(" "), F.element_at(parts, at + 1))
    joined = lambda at: F.when(at.isNotNull(), F.concat(F.slice(parts, 1, at - 1), F.array(merged(at)), F.slice(parts, at + 2, F.lit(4)))).otherwise(parts)
    return F.when(F.size(parts) == 5, marks.let(F.get(bare, F.lit(0)), joined)).otherwise(parts)


def members(text: Column) -> Column:
    """Array of (name, leg_idx, split_time, is_international) of a team's members, with or without times.

    Remarks in brackets, what follows a long dash and ``in heats:`` go. Parts end at a comma before a letter and where
    a name follows a time; one of five parts that has no time belongs to the next; of three parts, one may hold two
    names that a quote parts. A part's place is its leg, also where an empty part or one with ``;`` is left out.
    """
    text = F.regexp_replace(names.stripped(text), r"(?U),\s*$", "")
    text = F.regexp_replace(text, r"(?i)^in\s+heats:\s*", "")
    text = F.regexp_replace(text, r"(?U)\s*\[\s*[^\]]*\s*\]\s+(?=[A-Z])", ", ")
    text = names.stripped(F.regexp_replace(names.stripped(F.regexp_replace(text, r"(?U)\s*\[[^\]]*\]", "")), "—.*", ""))
    parts = _resplit(marks.let(F.split(text, r",\s*(?=[A-Za-z])"), _four_of_five), r"(?U)(?<=\d)\s+(?=[A-Z])")
    parts = marks.let(parts, lambda x: F.when(F.size(x) == 3, _resplit(x, r"'\s*(?=[A-Z])")).otherwise(x))

    def member(raw: Column, i: Column) -> Column:
        whole = F.translate(F.regexp_replace(names.stripped(raw), ",+$", ""), "’", "'")
        whole = names.stripped(F.regexp_replace(names.stripped(whole), r"^\.{2,}\s*", ""))
        timed = lambda bare, whole: F.coalesce(*[F.when(bare.rlike(form), F.struct(F.regexp_extract(bare, form, 1).alias("name"), F.regexp_extract(bare, form, 2).alias("time"))) for form in MEMBER_FORMS], F.struct(whole.alias("name"), F.lit(None).cast("string").alias("time")))
        of = lambda whole: marks.let(F.regexp_replace(F.regexp_replace(whole, "'+$", ""), r"\.+$", ""), lambda bare: marks.let(timed(bare, whole), lambda t: named(t, whole)))

        def named(t: Column, whole: Column) -> Column:
            one = lambda name: F.struct(
                names.stripped(F.regexp_replace(F.when(name.endswith("'"), names.stripped(F.regexp_replace(name, "'+$", ""))).otherwise(name), r"^\*+|\*+$", "")).alias("name"),
                (i + 1).alias("leg_idx"), F.replace(t["time"], F.lit("y"), F.lit("")).alias("split_time"), name.endswith("'").alias("is_international"), whole.alias("whole"),
            )
            return marks.let(names.stripped(t["name"]), one)

        return marks.let(whole, of)

    found = F.filter(F.transform(parts, member), lambda m: (m["whole"] != "") & ~m["whole"].contains(";"))
    return F.transform(found, lambda m: m.dropFields("whole"))


#: Suffixes of a name that follow a comma.
SUFFIXES = r"Jr\.|Sr\.|JR\.|SR\.|Jr|Sr|JR|SR|III|II|IV"


def indoor_members(text: Column, classes: dict[str, str]) -> Column:
    """Array of (name, leg_idx, split_time, class) of ``First LAST (SO) 46.91, ...``; a suffix is no member of its own.

    Leading record notes end by `` -- ``, as trailing ones begin; a text without a comma that doesn't look like a name
    is a note and gives none. Class and time stand in any order.
    """
    text = F.regexp_replace(names.stripped(text), r"(?i)^[a-z]*\(", "")
    text = F.regexp_replace(text, r"^(?:then-)?(?:[A-Z]{2,}(?:,?\s*)?)+--\s*", "")
    text = F.substring_index(text, " -- ", 1)
    note = ~text.contains(",") & ~text.rlike(r"^[A-Z][a-z]+\s+[A-Z]")
    opens, closes = (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit(""))) for sign in "()")
    text = F.when(text.endswith(")") & (opens < closes), names.stripped(F.regexp_replace(text, r"\)+$", ""))).otherwise(text)
    parts = F.filter(F.transform(F.split(text, rf",(?! (?:{SUFFIXES})\b)"), names.stripped), lambda x: x != "")

    def member(x: Column, i: Column) -> Column:
        code, time = part(x, r"^.*?\(([A-Z]{2})\)", 1), part(x, r"(?U)^.*?\s(\d{1,2}(?::\d+)?\.\d+)", 1)
        name = F.coalesce(part(x, r"(?U)^(.*?)\s\d{1,2}(?::\d+)?\.\d+", 1), x)
        name = names.cased(names.stripped(F.regexp_replace(name, r"\([A-Z]{2}\).*$", "")))
        known = F.try_element_at(F.create_map(*[F.lit(v) for pair in classes.items() for v in pair]), code)
        return F.struct(name.alias("name"), (i + 1).alias("leg_idx"), time.alias("split_time"), known.alias("class"))

    return F.when(F.coalesce(note | (text == ""), F.lit(True)), F.expr("array()").cast("array<struct<name:string,leg_idx:int,split_time:string,class:string>>")).otherwise(F.transform(parts, member))


#: Lines of notes among a team's lines.
NOTES = (
    r"(?i)^\s*\([\d.y+\-\sMRWRCRAJWJ:,]+\)\s*$", r"^\s*\(\d+:\d+\.?\d*[y+]?\s*[A-Z]*\)\s*$", r"(?i)^\s*\(\d{4}\.\d+y?\s*MR\)\s*$",
    r"^\s*\*\s*=", r"^\s*¶\s*=", r"(?i)^\s*\(also under", r"(?i)^\s*\(first school to win", r"(?i)^\s*\(low[-‐‑]altitude", r"(?i)^\s*\([\d.]+y?\s*low[-‐‑]altitude",
    r"(?i)^\s*\(.*officially\s", r"(?i)^\s*\(superior to", r"(?i)^\s*\(event not contested", r"(?i)^\s*\(but its", r"(?i)but its \w+ leading runners",
    r"(?i)^\s*\(auto lo[-‐‑]alt", r"(?i)^\s*\(note:", r"^\s*\(North Carolina Central set CR",
)
#: What a line in parentheses may hold beside members.
NO_MEMBERS = (r"(?i)^[\d.y+\-\sMRWRCRAJWJ:]+$", r"(?i)^\d{4}\.\d+y?\s*MR$", r"(?i)^\d{1,2} contestants", r"(?i)^\d+ finalists", r"(?i)^\d+\s*teams", r"^\?$")


def is_note(line: Column) -> Column:
    found = F.lit(False)
    for pattern in NOTES:
        found = found | line.rlike(pattern)
    # Most lines are none, which their first sign or two words tell at less cost.
    return (line.rlike(r"^\s*[(*¶]") | F.lower(line).contains("but its")) & found


def member_line(line: Column) -> Column:
    """Struct (content, complete): what a line says of a team's members, and whether it closes their parenthesis.

    The first form that matches counts: a parenthesis of its own, an indented list of names, any indented text that a
    closing parenthesis may end. content is null for lines with an old place or mark in brackets and for notes.
    """
    opened, indented, loose = r"^\s*\(([^)]*)(\)?)\s*[;.]?\s*$", r"^\s+([A-Za-z][A-Za-z\s'\-.]+(?:,\s*[A-Za-z][A-Za-z\s'\-.]+)*)\s*$", r"^\s+([^()]+)(\)?)\s*[;.]?\s*$"
    none, out = F.lit(None).cast("string"), lambda content, complete: F.struct(content.alias("content"), complete.alias("complete"))
    barren = lambda inner: reduce(or_, (inner.rlike(pattern) for pattern in NO_MEMBERS))
    in_form = lambda inner, closed: F.when(inner == "", out(none, closed)).when(barren(inner), out(none, F.lit(True))).otherwise(out(inner, closed))
    free = lambda text, ends: F.when(text == "", out(none, ends)).when(ends | text.rlike("[A-Za-z]"), out(text, ends)).otherwise(out(none, F.lit(False)))
    inside = lambda x, form, f: marks.let(names.stripped(F.regexp_extract(x, form, 1)), lambda text: f(text, F.regexp_extract(x, form, 2) == ")"))
    kinds = lambda x: (
        F.when(x.rlike(r"\[\d+\]|\[\d+\.\d+\]"), out(none, F.lit(False))).when(x.rlike(opened), inside(x, opened, in_form))
        .when(x.rlike(indented), out(names.stripped(F.regexp_extract(x, indented, 1)), F.lit(False))).when(x.rlike(loose), inside(x, loose, free)).otherwise(out(none, F.lit(False)))
    )
    return marks.let(line, kinds)


def status_word(line: Column) -> Column:
    """dnf, dq or dns of a line of dots that announces it for the next entry; null for other lines."""
    low = F.lower(line)
    word = F.when(low.contains("dnf"), F.lit("dnf")).when(low.contains("dq"), F.lit("dq")).when(low.contains("dns") | low.contains("dnc"), F.lit("dns"))
    return F.when(low.rlike(r"^(…|\.\.\.)"), word)


UNKNOWN_TEAM = r"(?i)^([A-Za-z][A-Za-z\s&'\-]+?)\s*\(personnel unknown\)\.?$"


def athlete_status(line: Column, schools: dict[str, str]) -> Column:
    """Struct (name, school, is_international, unknown_team) of the entry that a status line announces; null for others.

    The school is the last group in parentheses, or the one before if the last is a remark; ``School (personnel
    unknown)`` is a team whose members aren't known.
    """
    line = F.regexp_replace(names.stripped(line), r"^[.\s]+", "")

    def entry(x: Column, g: Column) -> Column:
        unknown = x.rlike(UNKNOWN_TEAM)
        school = F.when(unknown, F.regexp_extract(x, UNKNOWN_TEAM, 1)).otherwise(g["group"])
        bare = lambda name: names.stripped(F.regexp_replace(F.when(name.rlike("['’]$"), names.stripped(F.regexp_replace(name, "['’]+$", ""))).otherwise(name), r"^\*+", ""))
        one = lambda p: F.struct(F.when(~p["unknown"], bare(p["name"])).alias("name"), p["school"].alias("school"), (~p["unknown"] & p["name"].rlike("['’]$")).alias("is_international"), p["unknown"].alias("unknown_team"))
        return marks.let(F.struct(names.stripped(g["head"]).alias("name"), names.clean_school(school, schools).alias("school"), unknown.alias("unknown")), one)

    found = lambda x: marks.let(grouped(x), lambda g: F.when(g.isNotNull(), entry(x, g)))
    return marks.let(line, lambda x: F.when(x.rlike(r"^[A-Z][^()]*\([^)]+\)"), found(x)))


#: Days of a week, as headers begin dates.
WEEKDAYS = "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"


def header_parts(header: Column) -> Column:
    """Struct (year, location, date) of ``YYYY * place * Weekday, Month d``: of each kind of part, the last one."""
    parts = F.transform(F.split(header, r"\*"), names.stripped)
    last = lambda keep: F.try_element_at(F.filter(parts, keep), F.lit(-1))
    is_year, is_date = lambda x: x.rlike(r"^\d{4}$"), lambda x: x.rlike(f"(?i)^{WEEKDAYS}")
    return F.struct(last(is_year).cast("int").alias("year"), last(lambda x: ~is_year(x) & ~is_date(x)).alias("location"), last(lambda x: ~is_year(x) & is_date(x)).alias("date"))


def year_header(line: Column) -> Column:
    """The year of a line that holds nothing else."""
    return part(F.trim(F.regexp_replace(line, "\f", "")), r"^(\d{4})$", 1).cast("int")


def location(line: Column) -> Column:
    """The place of ``(City, State, Month d`` or ``(City; Month d``."""
    line = F.trim(line)
    return F.when(line.startswith("("), F.trim(F.coalesce(part(line, rf"^\(([A-Za-z][A-Za-z\s.\[\]]+(?:,\s*[A-Za-z][A-Za-z\s.]+)?),\s*{MONTHS}\s+\d{{1,2}}", 1), part(line, rf"^\(([A-Za-z][A-Za-z\s.]+);\s*{MONTHS}\s+\d{{1,2}}", 1))))


def meet_date(line: Column) -> Column:
    """``Month d`` of a line that begins with a place and a date, or with a date that ``)`` or ``;`` ends."""
    line = names.stripped(line)
    date = rf"({MONTHS}\s+\d{{1,2}})"
    forms = (
        rf"^\([A-Za-z][A-Za-z\s.\[\]]+(?:,\s*[A-Za-z][A-Za-z\s.]+)?,\s*{date}", rf"^\({date}(?:[–\-]\d+)?(?:\)|;)", rf"^\([A-Za-z][A-Za-z\s.]+;\s*{date}",
    )
    return F.when(line.startswith("("), F.regexp_replace(F.coalesce(*[part(line, form, 1) for form in forms]), r"\s+", " "))
