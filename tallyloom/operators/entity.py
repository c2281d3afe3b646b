"""Entity resolution: blocked pairs, decisions, connected components, stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import names
from tallyloom.functions.marks import span_gap
from tallyloom.operators.joins import hub_join
from tallyloom.operators.stages import kept, removed, spread
from tallyloom.operators.windows import numbered


#: Blocks of more rows than this are cut into parts of about as many, each of which meets each.
BLOCK_PART = 4096
#: Rows that are alike are gathered up to about as many; a gathered row has all pairs of its task's join buffered at once.
ALIKE_PART = 64


def blocked_pairs(df: DataFrame, identifier: str, block: list[str], match: Column | None = None) -> DataFrame:
    """Pairs (a, b) of rows in the same block, a's identifier the smaller; match sees columns a_x and b_x.

    Pairs grow with the square of a block, however few bytes its rows have, so that they are dealt out over four tasks a
    core; two parts of a large block are a join key of their own, so that no task holds a whole block.
    """
    df = df.dropna(subset=block)
    # Fewer than rows / BLOCK_PART.
    large = df.groupBy(*block).agg(F.ceil(F.count("*") / BLOCK_PART).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    cut = df.join(F.broadcast(large), block, "left").withColumns({"_parts": parts, "_own": F.pmod(F.xxhash64(identifier), parts).cast("int")})
    key = [*block, "_i", "_j"]

    def side(x: str, own: str, other: str) -> DataFrame:
        met = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias(other)
        return spread(cut.select(*[F.col(c).alias(c if c in block else f"{x}_{c}") for c in df.columns], F.col("_own").alias(own), met), *key)

    pairs = side("a", "_i", "_j").join(side("b", "_j", "_i").hint("merge"), key).drop("_i", "_j").filter(F.col(f"a_{identifier}") < F.col(f"b_{identifier}"))
    return pairs if match is None else pairs.filter(match)


def gathered(rows: DataFrame, identifier: str) -> DataFrame:
    """One row for rows that are alike but for the identifier, with an array of identifiers; several if they are many."""
    alike = [c for c in rows.columns if c != identifier]
    rows = rows.dropna(subset=[identifier]).withColumn("_alike", F.xxhash64(*alike))
    many = rows.groupBy("_alike").agg(F.ceil(F.count("*") / ALIKE_PART).cast("int").alias("_parts")).filter("_parts > 1")
    own = F.pmod(F.xxhash64(identifier), F.coalesce("_parts", F.lit(1))).alias("_own")
    return rows.join(many, "_alike", "left").groupBy(*alike, own).agg(F.collect_list(identifier).alias(identifier)).drop("_own")


def met_pairs(rows: DataFrame, identifier: str, block: list[str], key: str, meetings: DataFrame) -> DataFrame:
    """Pairs of gathered() rows whose keys a row of ``meetings`` (block.., a_key, b_key, more) brings together, with columns
    a_x, b_x and those of the meeting. A key that meets itself gives each pair both ways, and rows with themselves.

    They are dealt out as in blocked_pairs: parts of large keys meet as join keys of their own.
    """
    rows = rows.dropna(subset=[*block, key])
    large = rows.groupBy(*block, key).agg(F.ceil(F.sum(F.size(identifier)) / BLOCK_PART).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    own = rows.join(F.broadcast(large), [*block, key], "left").withColumn("_own", F.pmod(F.xxhash64(identifier), parts).cast("int")).drop("_parts")
    for x, at in (("a", "_i"), ("b", "_j")):
        of = large.select(*block, F.col(key).alias(f"{x}_{key}"), "_parts")
        meetings = meetings.join(F.broadcast(of), [*block, f"{x}_{key}"], "left").withColumn(at, F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    on = [*block, f"a_{key}", f"b_{key}", "_i", "_j"]

    def side(x: str, at: str, more: list[str]) -> DataFrame:
        named = own.select(*[F.col(c).alias(c if c in block else f"{x}_{c}") for c in rows.columns], F.col("_own").alias(at))
        return spread(named.join(meetings.select(*on, *more), [*block, f"{x}_{key}", at]), *on)

    return side("a", "_i", [c for c in meetings.columns if c not in on]).join(side("b", "_j", []).hint("merge"), on).drop("_i", "_j")


def close(a: Column, b: Column, distance: int = 1, longer: int = 2) -> Column:
    """Edit distance up to ``distance``; the lengths are compared first, and the distance stops when it is exceeded."""
    return (F.abs(F.length(a) - F.length(b)) <= longer) & (F.levenshtein(a, b, distance) >= 0)


def one_edit_pairs(df: DataFrame, identifier: str, block: list[str], text: str) -> DataFrame:
    """Pairs (a_, b_) of the same block, a's identifier the smaller, whose texts are one edit apart at most.

    Two such texts are equal or become so when one character goes from either, so that an equality join on the block
    and these forms finds them; its size grows with the number of texts, not with the square of a block.
    """
    rows = df.select(*block, F.col(identifier).alias("_i"), F.col(text).alias("_t"))
    less = F.transform(F.sequence(F.lit(1), F.length("_t")), lambda i: F.concat(F.substring("_t", F.lit(1), i - 1), F.substring("_t", i + 1, F.length("_t"))))
    forms = rows.withColumn("_form", F.explode(F.array_distinct(F.when(F.length("_t") > 0, F.array_append(less, F.col("_t"))).otherwise(F.array("_t")))))
    a, b = (forms.select(*block, "_form", F.col("_i").alias(f"{x}_{identifier}"), F.col("_t").alias(f"{x}_{text}")) for x in "ab")
    pairs = a.join(b, [*block, "_form"]).filter(F.col(f"a_{identifier}") < F.col(f"b_{identifier}")).drop("_form").distinct()
    return pairs.filter(F.levenshtein(f"a_{text}", f"b_{text}", 1) >= 0)


def linking_edges(df: DataFrame, identifier: str, block: list[str], value: str, most: int) -> DataFrame:
    """Edges (a, b) that link the same rows as all pairs of a block whose values differ by ``most`` at the most would.

    Rows of one value meet its least identifier, and each value's least identifier that of the next greater value, so
    that there are no more edges than twice the rows. Nulls link nothing.
    """
    rows = df.filter(F.col(value).isNotNull()).dropna(subset=block).select(*block, value, F.col(identifier).alias("a"))
    least = rows.groupBy(*block, value).agg(F.min("a").alias("b"))
    w = Window.partitionBy(*block).orderBy(value)
    steps = least.withColumns({"a": F.lag("b").over(w), "_before": F.lag(value).over(w)}).filter(F.col(value) - F.col("_before") <= most)
    return rows.join(least, [*block, value]).filter("a <> b").select("a", "b").unionByName(steps.select("a", "b"))


#: Disciplines by group, and the groups that one athlete may well combine.
EVENT_GROUPS = {
    "sprints": ["100m", "200m", "400m", "60m", "100m Hurdles", "110m Hurdles", "400m Hurdles", "60m Hurdles", "220y Hurdles", "500m"],
    "relays": ["4x100m Relay", "4x400m Relay", "4x800m Relay", "DMR"],
    "horizontal_jumps": ["Long Jump", "Triple Jump"],
    "distance": ["800m", "1500m", "Mile", "3000m", "5000m", "10000m", "Steeplechase"],
    "high_jump": ["High Jump"],
    "pole_vault": ["Pole Vault"],
    "multi_events": ["Decathlon", "Heptathlon", "Pentathlon"],
    "throws": ["Shot Put", "Discus", "Hammer", "Javelin", "Weight Throw"],
}
COMBINED = {
    "sprints": ["sprints", "relays", "horizontal_jumps", "multi_events"],
    "relays": ["sprints", "relays", "multi_events"],
    "horizontal_jumps": ["sprints", "horizontal_jumps", "multi_events"],
    "distance": ["distance", "multi_events"],
    "high_jump": ["high_jump", "multi_events"],
    "pole_vault": ["pole_vault", "multi_events"],
    "multi_events": ["sprints", "relays", "horizontal_jumps", "distance", "high_jump", "pole_vault", "multi_events", "throws"],
    "throws": ["throws", "multi_events"],
}


def event_groups(disciplines: Column) -> Column:
    """The groups of an array of disciplines; one of no group is left out."""
    by_name = F.create_map(*[F.lit(x) for group, names in EVENT_GROUPS.items() for name in names for x in (name, group)])
    return F.array_distinct(F.array_compact(F.transform(disciplines, lambda d: F.try_element_at(by_name, d))))


def compatible(a: Column, b: Column) -> Column:
    """Whether some group of a combines with some of b; where either has none, anything goes."""
    combined = F.create_map(*[x for group, others in COMBINED.items() for x in (F.lit(group), F.array(*map(F.lit, others)))])
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(F.flatten(F.transform(a, lambda g: combined[g])), b)


def by_priority(strategies: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """The union of strategies' pairs, each pair once: by the first strategy that has it."""
    all_ = None
    for k, (name, pairs) in enumerate(strategies):
        one = pairs.select(*key).withColumns({"strategy": F.lit(name), "_k": F.lit(k)})
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.groupBy(*key).agg(F.min_by("strategy", "_k").alias("strategy"))


def recommend(kind: Column, same_school: Column, gap: Column, combines: Column, far: int = 8) -> Column:
    """The decision table of candidate pairs: by the strategy that found them, school, years between and event groups."""
    return (
        F.when((kind == "exact") & same_school & (gap == 0), "same_high")
        .when((gap > far) & combines & (kind == "fuzzy"), "different_likely")
        .when(gap > far, "different")
        .when(~combines & (kind == "fuzzy"), "different_likely")
        .when(~combines, "different")
        .otherwise("same")
    )


def _name_pairs(keyed: DataFrame, block: list[str], text: str) -> DataFrame:
    """Pairs (a_name < b_name) of a block's names whose ``text`` is one edit apart at most, with both texts.

    Names of one text meet as its pairs do, so that texts are compared once, however many names share them.
    """
    texts = keyed.select(*block, text).distinct().withColumn("key", F.col(text))
    pairs = one_edit_pairs(texts, "key", block, text).select(*block, f"a_{text}", f"b_{text}")
    same = texts.select(*block, F.col(text).alias(f"a_{text}"), F.col(text).alias(f"b_{text}"))
    turned = pairs.select(*block, F.col(f"b_{text}").alias(f"a_{text}"), F.col(f"a_{text}").alias(f"b_{text}"))
    a, b = (keyed.select(*block, F.col(text).alias(f"{x}_{text}"), F.col("name").alias(f"{x}_name")) for x in "ab")
    return a.join(pairs.unionByName(turned).unionByName(same), [*block, f"a_{text}"]).join(b, [*block, f"b_{text}"]).filter("a_name < b_name")


def candidates(profiles: DataFrame, far: int = 8) -> DataFrame:
    """(a, b, strategy, gap, combines, same_school, recommendation) of pairs of profiles that may be one athlete.

    profiles: id, name, gender, school, first_year, last_year, groups. Within a gender and last name: equal names of
    different schools, and names that match by initials or whose first names are within one edit; of one first name, last
    names one edit apart, whatever their first letters; women of one school and first name, at most ``far`` years apart.
    Each pair comes once, by the first strategy that finds it. Equality joins throughout; pairs of rows are made last and
    never shuffled.
    """
    parts = {"last": names.last_name(F.col("name")), "given": names.first_name(F.col("name"))}
    rows = profiles.withColumns(parts)
    # Strategies but for school and years are of names alone, so that pairs are sought among distinct ones.
    keyed = profiles.select("gender", "name").distinct().withColumns(parts).withColumn("initial", F.lower(F.left(F.regexp_replace("given", r"[.']", ""), F.lit(1))))
    different = F.col("a_name") != F.col("b_name")
    initials = blocked_pairs(keyed.select("name", "gender", "last", "initial"), "name", ["gender", "last", "initial"], names.initials_match(F.col("a_name"), F.col("b_name")))
    fuzzy = _name_pairs(keyed.filter("length(given) > 2"), ["gender", "last"], "given")
    across = _name_pairs(keyed.filter("length(last) > 2"), ["gender", "given"], "last").filter("a_last <> b_last")
    found = kept(by_priority([("initials", initials), ("fuzzy", fuzzy), ("cross_fuzzy", across)], ["gender", "a_name", "b_name"]))
    same = keyed.select("gender", F.col("name").alias("a_name"), F.col("name").alias("b_name"), F.lit("exact").alias("strategy"))
    # Women's names that meet in a school, as far as no strategy before has them.
    women = rows.filter("gender = 'women'").select("gender", "school", "given", "name").distinct()
    married = blocked_pairs(women, "name", ["gender", "school", "given"]).join(found, ["gender", "a_name", "b_name"], "left_anti")
    # What is said of a pair follows from all but the identifiers and is the same either way, so that it is said once of
    # rows that are alike.
    alike = gathered(rows.select("gender", "name", "id", "school", "first_year", "last_year", "groups"), "id")
    gap = span_gap(F.col("a_first_year"), F.col("a_last_year"), F.col("b_first_year"), F.col("b_last_year"))
    # Equal names meet both ways.
    named = met_pairs(alike, "id", ["gender"], "name", found.unionByName(same)).filter((F.col("strategy") != "exact") | (F.col("a_school") < F.col("b_school")))
    wed = met_pairs(alike, "id", ["gender", "school"], "name", married.select("gender", "school", "a_name", "b_name", F.lit("maiden_married").alias("strategy"))).filter(gap <= far)
    kind = F.when(F.col("strategy") == "cross_fuzzy", "fuzzy").otherwise(F.col("strategy"))

    def judged(pairs: DataFrame, same_school: Column) -> DataFrame:
        both = pairs.select("a_id", "b_id", "strategy", gap.alias("gap"), compatible(F.col("a_groups"), F.col("b_groups")).alias("combines"), same_school.alias("same_school"))
        return both.withColumn("recommendation", recommend(kind, F.col("same_school"), F.col("gap"), F.col("combines"), far))

    both = judged(named, F.col("a_school") == F.col("b_school")).unionByName(judged(wed, F.lit(True)))
    each = both.withColumn("a_id", F.explode("a_id")).withColumn("b_id", F.explode("b_id")).filter("a_id <> b_id")
    return each.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "strategy", "gap", "combines", "same_school", "recommendation")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for edges (a, b), root being the smallest node of the component.

    Large-star and small-star steps until nothing changes; each round is a table in the checkpoint folder. Hubs, whose
    edges are a great share of all, meet their least neighbour by broadcast.
    """
    now, before = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(most_rounds):
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = kept(now.unionByName(up).groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
        large = kept(hub_join(up, least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        own = kept(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        several = hub_join(large, own.filter("n > 1"), "a", "n").select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
        after = kept(own.filter("n = 1").select("a", F.col("m").alias("b")).unionByName(several).filter("a <> b").distinct())
        removed(least)
        removed(own)
        removed(now)
        removed(large)
        now = after
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sums == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = sums
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def contradictions(roots: DataFrame, different: DataFrame) -> DataFrame:
    """Pairs decided to be different that ended in one component."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
    return different.join(a, "a").join(b, "b").filter("root_a = root_b").select("a", "b", F.col("root_a").alias("root"))


def stable_ids(groups: DataFrame, known: DataFrame, first: int = 10001, abort: bool = False) -> DataFrame:
    """(root, id, status) of each component: ``reused`` if one identifier is known among its nodes, else ``new``,
    numbered on from the largest known one by root.

    ``merged`` (several identifiers in a component) and ``split`` (one that several components claim) have no id; with
    abort, they raise.
    """
    hits = groups.join(known, "node", "left").groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    claims = hits.filter(F.size("ids") == 1).groupBy(F.col("ids")[0].alias("claimed")).agg(F.count("*").alias("claims"))
    hits = hits.withColumn("claimed", F.get("ids", F.lit(0))).join(claims, "claimed", "left")
    status = F.when(F.size("ids") == 0, "new").when(F.size("ids") > 1, "merged").when(F.col("claims") > 1, "split").otherwise("reused")
    marked = hits.select("root", status.alias("status"), F.when(status == "reused", F.col("claimed")).alias("id"))
    if abort and (wrong := marked.filter("status in ('merged', 'split')").limit(5).collect()):
        raise ValueError(f"identifiers that components merge or split: {[(r.root, r.status) for r in wrong]}")
    start = known.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(first - 1))).first()[0]
    new = numbered(marked.filter("status = 'new'").select("root", "status"), ["root"], int(start), "id")
    return new.select("root", "id", "status").unionByName(marked.filter("status <> 'new'").select("root", F.col("id").cast("long"), "status"))


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).filter("_n = 1").drop("_n")
