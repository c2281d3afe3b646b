"""Whole text documents to result rows: lines with features, one fold over the lines of a section, and joins.

A document's sections begin at its year headers and don't depend on each other, so that they are dealt out to tasks by
(document, section). What a line says by itself are column expressions; what it can see ahead (does a list of members
follow before the search for it would stop?) are windows. Only the order in which lines are used up needs state: a
status is used once, a team takes the lines of its members, and a line that is taken does nothing else. This fold goes
once over sorted lines and holds a handful of values, whatever a section's length. All rows are then put together by
joins and groupings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import lines as grammar
from tallyloom.functions import marks, names
from tallyloom.operators.joins import inherited
from tallyloom.operators.stages import kept
from tallyloom.operators.windows import filled, padded, sections

#: Name of a runner of a team whose members aren't known, and how many a team has.
UNKNOWN_MEMBER, TEAM = "Relay member unknown", 4
SECTION = r"(?i)^\s*Section\s+(I|II|1|2)\s*:?\s*$"
COMPOSITE = r"(?i)^Composite finish\s*:?\s*$"
NOT_HELD = ("(meet not held)", "(meet not held")


def numbered_pages(lines: DataFrame, doc: str, line_no: str, line: str) -> DataFrame:
    """lines with page_no: the form feeds that begin lines, up to and with each line of its document."""
    return sections(lines, [doc], [line_no], F.col(line).startswith("\f"), "page_no")


def without_first_page(lines: DataFrame, doc: str, line_no: str, line: str, when: Column, year: int) -> DataFrame:
    """Leaves out what follows the header of ``year`` on the first page of the documents that ``when`` picks."""
    paged = sections(numbered_pages(lines, doc, line_no, line), [doc], [line_no], grammar.year_header(F.col(line)) == year, "_seen")
    is_header = F.coalesce(grammar.year_header(F.col(line)) == year, F.lit(False)) & (F.col("_seen") == 1)
    return paged.filter(~F.coalesce(when & (F.col("page_no") == 0) & (F.col("_seen") > 0) & ~is_header, F.lit(False))).drop("page_no", "_seen")


def with_features(lines: DataFrame, doc: str, line_no: str, line: str, relay: Column, classes: dict[str, str], schools: dict[str, str], splits: list[tuple]) -> DataFrame:
    """What each line says by itself, its section and year, and what it sees ahead. Lines before a year header go."""
    text = names.stripped(F.col(line))
    rows = lines.select(F.col(doc).alias("doc"), F.col(line_no).alias("line_no"), F.col(line).alias("line"), relay.alias("is_relay"), grammar.year_header(F.col(line)).alias("header"))
    rows = sections(rows, ["doc"], ["line_no"], F.col("header").isNotNull())
    rows = filled(rows, ["doc"], ["line_no"], {"year": F.col("header")}).filter("section > 0 AND header IS NULL")
    line, text = F.col("line"), names.stripped(F.col("line"))
    # Columns of their own, as the features below name them several times.
    rows = rows.withColumns({"text": text, "note": grammar.is_note(line), "_own": grammar.member_line(line)})
    text, note, own = F.col("text"), F.col("note"), F.col("_own")
    blank, left, closed = text == "", ~line.rlike(r"^[ \t]"), text.endswith(")")
    closing = names.stripped(F.regexp_replace(text, r"\)+$", ""))
    is_section = line.rlike(SECTION)
    parsed = grammar.placed(text)
    rows = rows.withColumns({
        "is_section": is_section, "is_composite": text.rlike(COMPOSITE), "not_held": text.isin(*NOT_HELD), "dots": text.rlike(r"^(…|\.\.\.)"), "status": grammar.status_word(text),
        "content": F.when(~is_section & ~note, own["content"]), "complete": F.when(~is_section & ~note, own["complete"]).otherwise(F.lit(False)),
        "placed": parsed, "athlete": grammar.athlete_status(line, schools), "announced": F.when(F.col("is_relay"), grammar.relay_status(text, schools)),
        "wind_here": marks.parse_wind(text), "location_here": grammar.location(text), "date_here": grammar.meet_date(text),
    })
    rows = rows.drop("_own")
    free = ~F.col("note") & ~F.col("is_section") & F.col("content").isNull()
    tail = F.when(free & closed & closing.rlike("[A-Za-z]"), closing)
    rows = rows.withColumns({
        "team": F.when(F.col("is_relay") & F.col("placed.place").isNotNull(), grammar.relay(F.col("placed.rest"), schools)),
        "single": F.when(~F.col("is_relay") & F.col("placed.place").isNotNull(), grammar.individual(F.col("placed.rest"), classes, schools)),
        "gain": F.coalesce(F.col("content"), tail),
        "bars": F.col("is_section") | free & (F.col("complete") | blank), "halts": F.col("is_section") | free & ~closed & (blank | left),
    })
    # Backwards, as Spark goes over the rest of the rows again for each row of a frame that is open to the end.
    ahead = Window.partitionBy("doc", "section").orderBy(F.col("line_no").desc())
    here, after = ahead.rowsBetween(Window.unboundedPreceding, 0), ahead.rowsBetween(Window.unboundedPreceding, -1)
    first = lambda condition, w: F.min(F.when(condition, F.col("line_no"))).over(w)
    before = lambda a, b: F.coalesce(a < b, a.isNotNull())  # noqa: E731  a comes before b, or there is no b
    rows = rows.withColumn("found", before(first(F.col("content").isNotNull(), here), first(F.col("bars"), here)))
    rows = rows.withColumn("more", before(first(F.col("gain").isNotNull(), after), first(F.col("halts"), after)))
    return rows.withColumn("found_next", F.coalesce(F.lag("found").over(ahead), F.lit(False))).drop("bars", "halts", "header")


class _Fold:
    """The state of a section: the pending status, the relay whose members may follow, and whether lines are being taken."""

    def __init__(self) -> None:
        self.key = None

    def begin(self, key: tuple) -> None:
        self.key, self.pending, self.relay, self.in_section, self.block, self.owner, self.begun = key, None, None, False, 0, None, False

    def take(self, line: dict) -> dict:
        """A line of a team's members: the owner it belongs to, and whether the team goes on."""
        gain = line["content"] or (line["gain"] if self.begun else None)
        out = {"member_of": self.owner} if gain is not None else {}
        if gain is not None:
            ends = line["complete"] if line["content"] is not None else True
            self.begun = True
            if ends or not line["more"]:
                self.owner = None
        return out

    def step(self, at: int, line: dict) -> dict:
        """What the line is: seen (its context counts), event, status, and the relay whose team begins or isn't known."""
        if self.owner is not None:
            return self.take(line)
        if line["not_held"]:
            return {}
        out = {"seen": True, "in_section": self.in_section, "block": self.block}
        if line["dots"]:
            self.pending = line["status"] or self.pending
            return out
        if self.pending and line["is_athlete"]:
            out |= {"event": "athlete", "status": self.pending}
            self.pending = None
            return out
        if self.pending and line["is_announced"]:
            out |= {"event": "announced", "status": self.pending}
            self.pending = self.relay = None
            if line["found_next"]:
                self.owner, self.begun = at, False
                out["team_of"] = at
            return out
        self.pending = None
        if self.relay is not None:
            relay, self.relay = self.relay, None
            if not (self.block and not self.in_section):
                if line["found"]:
                    self.owner, self.begun = relay, False
                    return out | {"team_of": relay} | self.take(line)
                out["unknown_of"] = relay
        if line["is_composite"]:
            self.in_section, self.block = False, self.block + 1
        elif line["is_section"]:
            self.in_section, self.relay = True, None
        elif line["is_team"]:
            self.relay = at
            out["event"] = "team"
        elif line["is_single"]:
            out["event"] = "single"
        return out


FOLD_INPUT = ["content", "gain", "complete", "more", "found", "found_next", "not_held", "dots", "status", "is_athlete", "is_announced", "is_composite", "is_section", "is_team", "is_single"]
FOLD_OUTPUT = [("seen", pa.bool_(), "boolean"), ("event", pa.string(), "string"), ("said", pa.string(), "string"), ("team_of", pa.int64(), "long"), ("unknown_of", pa.int64(), "long"), ("member_of", pa.int64(), "long"), ("in_section", pa.bool_(), "boolean"), ("block", pa.int32(), "int")]


def used_up(rows: DataFrame) -> DataFrame:
    """with_features() with what the fold makes of each line; see _Fold.step(). Lines stream through it in order."""
    has = {"is_athlete": "athlete", "is_announced": "announced", "is_team": "team", "is_single": "single"}
    rows = rows.withColumns({new: F.col(old).isNotNull() for new, old in has.items()})
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Fold()
        for batch in batches:
            keys = zip(batch.column("doc").to_pylist(), batch.column("section").to_pylist(), batch.column("line_no").to_pylist(), strict=True)
            facts = zip(*(batch.column(c).to_pylist() for c in FOLD_INPUT), strict=True)
            out = []
            for (doc, section, at), fact in zip(keys, facts, strict=True):
                if (doc, section) != state.key:
                    state.begin((doc, section))
                out.append(state.step(at, dict(zip(FOLD_INPUT, fact, strict=True))))
            of = {"said": "status"}
            made = [pa.array([o.get(of.get(name, name)) for o in out], kind) for name, kind, _ in FOLD_OUTPUT]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*columns, *(name for name, _, _ in FOLD_OUTPUT)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"{name} {kind}" for name, _, kind in FOLD_OUTPUT)])
    dealt = rows.withColumn("line_no", F.col("line_no").cast("long")).repartition("doc", "section").sortWithinPartitions("doc", "section", "line_no")
    return dealt.mapInArrow(run, schema.replace("`line_no` int", "`line_no` long"))


def joined_contents(used: DataFrame) -> DataFrame:
    """(doc, section, owner, member_text): the lines of each team's members as one text, with commas where none stands."""
    told = used.filter("member_of IS NOT NULL").groupBy("doc", "section", F.col("member_of").alias("owner")).agg(F.array_sort(F.collect_list(F.struct("line_no", "gain"))).alias("parts"))
    add = lambda a, x: F.when(a == "", x["gain"]).when(a.rlike(r",\s*$") | x["gain"].rlike(r"^\s*,"), F.concat(a, F.lit(" "), x["gain"])).otherwise(F.concat(a, F.lit(" , "), x["gain"]))
    return told.select("doc", "section", "owner", F.aggregate("parts", F.lit(""), add).alias("member_text"))


def results(lines: DataFrame, doc: str, line_no: str, line: str, relay: Column, classes: dict[str, str], schools: dict[str, str], splits: list[tuple] = ()) -> DataFrame:
    """The result rows of documents, one per athlete or per leg of a relay team.

    ``relay`` says of a line whether its document is of a relay event. A team without members has four unknown ones; a
    composite listing gives its place, mark and flags to the teams of the sections below it, and no rows of its own; a
    team of a section that it lacks has no place. Null lines count as blank ones. A document without a year header
    gives no rows. Schools are cleaned twice, without and with the year.
    """
    lines = lines.withColumn(line, F.coalesce(line, F.lit("")))
    used = kept(used_up(with_features(lines, doc, line_no, line, relay, classes, schools, splits)))
    when_seen = lambda c: F.when(F.col("seen"), F.col(c))
    context = filled(used, ["doc", "section"], ["line_no"], {"wind": when_seen("wind_here"), "location": when_seen("location_here"), "date": when_seen("date_here")})
    context = kept(context.filter("event IS NOT NULL OR team_of IS NOT NULL OR unknown_of IS NOT NULL").withColumn("event", F.coalesce("event", F.lit(""))))
    key, told = ["doc", "section"], ["line_no", "year", "wind", "location", "date"]
    none = lambda kind: F.lit(None).cast(kind)

    def row(df: DataFrame, **own: Column) -> DataFrame:
        flags = {f"is_{s}": F.coalesce(own.get("said", none("string")) == s, F.lit(False)) for s in ("dq", "dnf", "dns")}
        blank = {"place": none("int"), "name": none("string"), "school": none("string"), "class": none("string"), "mark_num": none("double"), "mark_str": none("string"), "leg_idx": none("int"), "split_time": none("string")}
        values = blank | {f: F.lit(False) for f in ("is_wind_aided", "is_international", "is_converted", "is_relay")} | flags | {k: v for k, v in own.items() if k != "said"}
        values["school"] = names.clean_school(values["school"], schools, F.col("year"), splits)
        return df.select(*key, *told, *[v.alias(k) for k, v in values.items()])

    single = row(
        context.filter("event = 'single'"), place=F.col("placed.place"), **{c: F.col(f"single.{c}") for c in ("name", "school", "class", "mark_num", "mark_str")},
        is_wind_aided=F.col("single.wind_aided"), is_international=F.col("single.international"), is_converted=F.col("single.converted") | F.col("placed.converted"),
    )
    legs = padded(context.filter("event = 'athlete'"), F.when(F.col("athlete.unknown_team"), F.lit(TEAM)).otherwise(F.lit(0)), "leg_idx")
    athlete = row(
        legs, name=F.coalesce("athlete.name", F.lit(UNKNOWN_MEMBER)), school=F.col("athlete.school"), leg_idx=F.col("leg_idx"), said=F.col("said"),
        is_international=F.col("athlete.is_international"), is_relay=F.col("is_relay"),
    )
    contents = joined_contents(used)
    one = lambda df: df.join(contents, key + ["owner"], "left").select(*df.columns, F.explode_outer(grammar.members(F.col("member_text"))).alias("m"))
    announced = one(context.filter("event = 'announced'").withColumn("owner", F.col("line_no")))
    announced = row(
        announced, place=F.col("announced.original_place"), name=F.coalesce("m.name", "announced.school"), school=F.col("announced.school"), mark_num=F.col("announced.mark_num"), mark_str=F.col("announced.mark_str"), leg_idx=F.col("m.leg_idx"), split_time=F.col("m.split_time"),
        said=F.col("said"), is_international=F.coalesce("m.is_international", F.lit(False)), is_relay=F.lit(True),
    )
    team_columns = ["place", "mark_num", "mark_str", "is_wind_aided", "is_dq", "is_dnf", "is_converted"]
    teams = context.filter("event = 'team'").select(
        *key, F.col("line_no").alias("owner"), "in_section", "block", names.clean_school(F.col("team.school"), schools, F.col("year"), splits).alias("school"), F.col("placed.place").alias("place"),
        F.col("team.mark_num").alias("mark_num"), F.col("team.mark_str").alias("mark_str"), F.col("team.wind_aided").alias("is_wind_aided"), F.col("team.is_dq").alias("is_dq"), F.col("team.is_dnf").alias("is_dnf"),
        (F.col("team.converted") | F.col("placed.converted")).alias("is_converted"),
    )
    listing = teams.filter("block > 0 AND NOT in_section").groupBy(*key, "block", "school").agg(*[F.max_by(c, "owner").alias(c) for c in team_columns])
    in_sections = inherited(teams.filter("in_section"), listing, [*key, "block", "school"], team_columns, blank=["place"])
    teams = teams.filter("NOT in_section").unionByName(in_sections)
    begun = context.filter("team_of IS NOT NULL AND event <> 'announced'").select(*key, *told, F.col("team_of").alias("owner"), F.lit(False).alias("unknown"))
    begun = begun.unionByName(context.filter("unknown_of IS NOT NULL").select(*key, *told, F.col("unknown_of").alias("owner"), F.lit(True).alias("unknown")))
    met = begun.join(teams, [*key, "owner"])
    unknown = padded(met.filter("unknown"), F.lit(TEAM), "leg_idx").withColumn("m", F.expr("named_struct('name', CAST(NULL AS STRING), 'split_time', CAST(NULL AS STRING), 'is_international', false)"))
    known = one(met.filter("NOT unknown")).filter("m IS NOT NULL").withColumn("leg_idx", F.col("m.leg_idx"))
    unknown = unknown.withColumns({"name": F.lit(UNKNOWN_MEMBER), "split_time": F.col("m.split_time"), "is_international": F.lit(False)}).drop("m")
    known = known.withColumns({"name": F.col("m.name"), "split_time": F.col("m.split_time"), "is_international": F.col("m.is_international")}).drop("m")
    relays = row(known.unionByName(unknown), **{c: F.col(c) for c in ["name", "school", "leg_idx", "split_time", "is_international", *team_columns]}, is_relay=F.lit(True))
    out = single
    for more in (athlete, announced, relays):
        out = out.unionByName(more)
    return out.drop("section").withColumnsRenamed({"doc": doc, "line_no": line_no})
