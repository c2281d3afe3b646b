"""Profiles of athletes: assembly from decisions, application to results, pages and categories of outside sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import names
from tallyloom.operators.entity import components, contradictions
from tallyloom.operators.stages import kept, removed
from tallyloom.operators.windows import numbered

UNKNOWN_MEMBER = "Relay member unknown"
NODE = ["name", "school", "gender", "year_start", "year_end"]


# --- assembly -------------------------------------------------------------------------------------------------------


def node_key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def decided_edges(decisions: DataFrame, nodes: DataFrame, key: str = "pair", decision: str = "decision", ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, a, b, a_name, b_name, a_known, b_known, decision) of decisions ``name|school|gender|start|end::...``.

    An end whose name (quotes made plain), school and gender a node has is that node, whatever its years were when the
    decision was made; any other end keeps the years it names and isn't known. Open (``skip``) decisions go.
    """
    ends = F.split(key, "::")
    rows = decisions.filter(F.col(decision) != "skip").select(F.col(ordinal).alias("ordinal"), F.col(decision).alias("decision"), ends[0].alias("a"), ends[1].alias("b"))
    current = nodes.select(F.col("name"), F.col("school"), F.col("gender"), node_key(*NODE).alias("_now"))
    for x in "ab":
        parts = F.split(x, r"\|")
        rows = rows.withColumns({f"{x}_name": names.straight_quotes(parts[0]), "_school": parts[1], "_gender": parts[2], "_old": F.concat_ws("|", names.straight_quotes(parts[0]), *[parts[i] for i in range(1, 5)])})
        met = (F.col(f"{x}_name") == F.col("name")) & (F.col("_school") == F.col("school")) & (F.col("_gender") == F.col("gender"))
        rows = rows.join(current, met, "left").withColumns({x: F.coalesce("_now", "_old"), f"{x}_known": F.col("_now").isNotNull()}).drop("name", "school", "gender", "_now", "_school", "_gender", "_old")
    return rows


def assemble(nodes: DataFrame, decisions: DataFrame, abort: bool = True) -> DataFrame:
    """Profiles (root, canonical_name, aliases, members) from nodes (NODE, rows, ordinal) and decisions between them.

    Nodes that are decided to be the same, also by way of an end that isn't known, are one profile; pairs of two unknown
    ends count for nothing. Its name is the most frequent one set by hand (``same_custom:Name``), else the most frequent
    of those that decisions prefer (``same_a``, ``same_b``), else that of most rows; earlier ones win ties. Members are
    by ordinal. A pair decided to be different within one profile raises, unless abort is off.
    """
    nodes = nodes.withColumn("_key", node_key(*NODE))
    edges = kept(decided_edges(decisions, nodes))
    same = edges.filter("decision <> 'different' AND (a_known OR b_known)")
    roots = kept(components(same.select("a", "b")))
    if abort:
        wrong = contradictions(roots, edges.filter("decision = 'different'").select("a", "b")).limit(5).collect()
        if wrong:
            raise ValueError(f"decided to be different but the same by other decisions: {[(r.a, r.b) for r in wrong]}")
    rooted = nodes.join(roots.withColumnRenamed("node", "_key"), "_key", "left").withColumn("root", F.coalesce("root", "_key"))
    custom = F.when(F.col("decision").startswith("same_custom:"), F.regexp_extract("decision", "^same_custom:(.*)$", 1))
    hinted = same.withColumn("name", F.coalesce(custom, F.when(F.col("decision") == "same_a", F.col("a_name")).when(F.col("decision") == "same_b", F.col("b_name")))).filter("name IS NOT NULL")
    hinted = hinted.join(roots.withColumnRenamed("node", "a"), "a").select("root", "name", F.when(custom.isNotNull(), 0).otherwise(1).alias("source"), F.lit(1).cast("long").alias("n"), F.col("ordinal").cast("long").alias("at"))
    own = rooted.select("root", "name", F.lit(2).alias("source"), F.col("rows").cast("long").alias("n"), F.col("ordinal").cast("long").alias("at"))
    counted = hinted.unionByName(own).groupBy("root", "source", "name").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    chosen = counted.groupBy("root").agg(F.min_by("name", F.struct("source", -F.col("n"), "at")).alias("canonical_name"))
    members = rooted.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("ordinal", *NODE))).alias("_members"), F.collect_set("name").alias("_names"))
    out = members.join(chosen, "root")
    listed = F.transform("_members", lambda m: F.struct(*[m[c].alias(c) for c in NODE]))
    return out.select("root", "canonical_name", F.array_sort(F.array_union("_names", F.array("canonical_name"))).alias("aliases"), listed.alias("members"))


# --- application ----------------------------------------------------------------------------------------------------


def apply_profiles(results: DataFrame, members: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """results with athlete_id, and the (name, school, gender, id) that were newly made.

    members: (athlete_id, ordinal, name, gender, school, year_start, year_end); the first of a row's name, gender and
    school whose years hold the row's gives its identifier; a null end is open. All other rows, but for unknown
    members, have one identifier for each name, school and gender, whatever gaps their years have: that of ``known``
    (name, school, gender, id), else a new one, numbered on in order. Nulls in name, school or gender match nothing and
    get no identifier. Quotes of names are made plain; an earlier athlete_id is reset. The first member is found for each
    key and each year that results have, so that rows meet it by equality, however many members a key has.
    """
    key = ["name", "gender", "school"]
    rows = results.drop("athlete_id").withColumn("name", names.straight_quotes(F.col("name")))
    span = F.struct("ordinal", F.col("year_start").alias("s"), F.col("year_end").alias("e"), "athlete_id")
    spans = members.withColumn("name", names.straight_quotes(F.col("name"))).groupBy(*key, "year_start", "year_end").agg(F.min(span).alias("_span"))
    holds = (F.col("year") >= F.col("year_start")) & (F.col("year_end").isNull() | (F.col("year") <= F.col("year_end")))
    first = spans.join(F.broadcast(rows.select("year").distinct()), holds).groupBy(*key, "year").agg(F.min("_span")["athlete_id"].cast("long").alias("athlete_id"))
    rows = rows.join(first, [*key, "year"], "left")
    named = F.col("name").isNotNull() & F.col("school").isNotNull() & F.col("gender").isNotNull()
    left = rows.filter(F.col("athlete_id").isNull() & named & (F.col("name") != UNKNOWN_MEMBER)).select(*key).distinct()
    have = known.select(*key, F.col("id").cast("long").alias("id"))
    start = have.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(left.join(have, key, "left_anti"), key, start, "id")
    ids = left.join(have, key).unionByName(new).withColumnRenamed("id", "_id")
    out = rows.join(ids, key, "left").withColumn("athlete_id", F.coalesce("athlete_id", F.when(F.col("name") != UNKNOWN_MEMBER, F.col("_id")))).drop("_id")
    return out.select(*[c for c in results.columns if c != "athlete_id"], "athlete_id"), new


def displayed(df: DataFrame, profiles: DataFrame, key: str, display: str, fallback: str, name: str) -> DataFrame:
    """df with the profile's display name, or its own where it has no profile."""
    return df.join(profiles.select(key, F.col(display).alias("_display")), key, "left").withColumn(name, F.coalesce("_display", fallback)).drop("_display")


def nickname_pair(nicknames: Column) -> Column:
    """Struct (men, women) of an array of (nickname, used_by): the last one for each; one of neither is of both."""
    start = F.struct(F.lit(None).cast("string").alias("men"), F.lit(None).cast("string").alias("women"))

    def step(a: Column, x: Column) -> Column:
        is_men, is_women = F.coalesce(x["used_by"] == "men", F.lit(False)), F.coalesce(x["used_by"] == "women", F.lit(False))
        return F.struct(F.when(is_women, a["men"]).otherwise(x["nickname"]).alias("men"), F.when(is_men, a["women"]).otherwise(x["nickname"]).alias("women"))

    return F.aggregate(F.coalesce(nicknames, F.expr("array()").cast("array<struct<nickname:string,used_by:string>>")), start, step)


def school_dimension(schools: DataFrame, order: list[str], name: str = "name", nicknames: str = "nicknames") -> DataFrame:
    """school_id (from 1, in ``order``), the columns of schools, men_nickname and women_nickname. A repeated name fails."""
    rest = [c for c in schools.columns if c != name]
    one = schools.groupBy(name).agg(F.count("*").alias("_n"), F.min(F.struct(*rest)).alias("_one"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("a school twice: "), F.col(name)))).otherwise(F.col(name))
    one = one.select(checked.alias(name), *[F.col("_one")[c].alias(c) for c in rest])
    ids = numbered(one, order, name="school_id").withColumn("_pair", nickname_pair(F.col(nicknames)))
    return ids.select("school_id", *[c for c in schools.columns if c != nicknames], F.col("_pair.men").alias("men_nickname"), F.col("_pair.women").alias("women_nickname"))


def with_school_ids(results: DataFrame, dimension: DataFrame, school: str = "school", abort: bool = True) -> DataFrame:
    """results with the school_id of their school, an earlier one reset; with abort, a school that isn't there fails the job."""
    side = dimension.select(F.col("name").alias(school), F.col("school_id").alias("_id"))
    out = results.drop("school_id").join(side, school, "left")
    missing = F.raise_error(F.concat(F.lit("no such school: "), F.coalesce(school, F.lit("null")))).cast("long")
    return out.withColumn("school_id", F.coalesce("_id", missing) if abort else F.col("_id")).drop("_id")


# --- pages and categories of outside sources ------------------------------------------------------------------------


def resolved_redirects(redirects: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(page, target) with chains followed to their end by doubling steps; pages that lead into a circle are left out.

    redirects: (page, target), one per page (the least target counts). After k rounds a pointer spans 2^k steps, so that
    the rounds are the logarithm of the longest chain; each is written. What still points to a redirect after as many
    rounds as there could be steps goes round in a circle.
    """
    start = kept(redirects.filter("page <> target").groupBy("page").agg(F.min("target").alias("target")))
    sources = start.select(F.col("page").alias("target"), F.lit(True).alias("_again"))
    now, total, spanned = start, start.count(), 1
    for _ in range(most_rounds):
        following = now.select(F.col("page").alias("target"), F.col("target").alias("_next"))
        after = kept(now.join(following, "target", "left").select("page", F.coalesce("_next", "target").alias("target")))
        if now is not start:
            removed(now)
        now, spanned = after, spanned * 2
        if spanned > total or now.join(sources, "target", "left_semi").isEmpty():
            break
    return now.join(sources, "target", "left").filter("_again IS NULL").select("page", "target")


def merged_pages(matches: DataFrame, redirects: DataFrame, entity: str) -> DataFrame:
    """(entity, page, source, categories, school_categories, n_pages, needs_review): matches put together by the page that
    they end at.

    matches: (entity, ordinal, page, source, categories, school_categories); those without any category go. A page is
    ``exact`` if one of its matches is, else of its first match's source, the least of those of one ordinal; its
    categories are the union in order. Several pages of an entity need review.
    """
    met = matches.filter((F.size(F.coalesce("categories", F.array())) > 0) | (F.size(F.coalesce("school_categories", F.array())) > 0))
    met = met.join(resolved_redirects(redirects), "page", "left").withColumn("page", F.coalesce("target", "page"))
    whole = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    pages = met.groupBy(entity, "page").agg(
        F.when(F.bool_or(F.col("source") == "exact"), F.lit("exact")).otherwise(F.min_by("source", F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "source")))).alias("source"), whole("categories").alias("categories"), whole("school_categories").alias("school_categories")
    )
    counts = pages.groupBy(entity).agg(F.count("*").alias("n_pages"))
    return pages.join(counts, entity).withColumn("needs_review", F.col("n_pages") > 1)


def partitioned_cache(cache: DataFrame, current: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(valid, stale) rows of a cache, the last of each key by ``order``, by whether current still has the key."""
    last = cache.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter("_n = 1").drop("_n")
    keys = current.select(key).distinct()
    return last.join(keys, key, "left_semi"), last.join(keys, key, "left_anti")


def stable_key(canonical: Column, members: Column) -> Column:
    """``name|schools in order|gender|first year|last year`` of a profile, the same however its members are ordered."""
    schools = F.array_sort(F.array_distinct(F.filter(F.transform(members, lambda m: m["school"]), lambda s: s.isNotNull() & (s != ""))))
    part = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    gender = F.array_min(F.transform(members, lambda m: m["gender"]))
    first, last = F.array_min(F.transform(members, lambda m: m["year_start"])), F.array_max(F.transform(members, lambda m: m["year_end"]))
    return F.concat_ws("|", part(canonical), F.array_join(schools, ";"), part(gender), part(first), part(last))


def name_variants(df: DataFrame, aliases: str, name: str) -> DataFrame:
    """df with each alias as it is and without diacritics, in order, each once."""
    bare = df.select("*", F.posexplode_outer(aliases).alias("_at", "_alias")).withColumn("_bare", names.strip_diacritics("_alias"))
    again = bare.groupBy(*df.columns).agg(F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_alias", "_bare")))).alias("_all"))
    return again.withColumn(name, F.array_distinct(F.flatten(F.transform("_all", lambda x: F.array(x["_alias"], x["_bare"]))))).drop("_all")


def team_category(category: Column, men: Column, women: Column, gender: Column) -> Column:
    """The category of a school's team: of two different nicknames the other one goes, else the gender is said."""
    two = men.isNotNull() & women.isNotNull() & (men != women)
    bare = F.when(gender == "men", F.replace(category, F.concat(F.lit(" and "), women))).otherwise(F.replace(category, F.concat(men, F.lit(" and "))))
    said = F.concat(category, F.when(gender == "men", F.lit(" men's")).otherwise(F.lit(" women's")))
    return F.concat(F.when(F.coalesce(two, F.lit(False)), bare).otherwise(said), F.lit(" track and field athletes"))


def category_suggestions(entries: DataFrame, schools: DataFrame, reviewed: DataFrame, entity: str) -> DataFrame:
    """(entity, canonical_name, pages, expected): entities whose open pages lack a category that their schools call for.

    entries: (entity, canonical_name, gender, schools, matches of (page, categories)); schools: (name, category,
    men_nickname, women_nickname), those without a category go; reviewed: (canonical_name, page). An entity of which one
    open page has all expected categories, whatever their case, is left out, as are those without gender, schools, open
    pages or categories. Both sides of the subset test are arrays of one entity.
    """
    open_ = entries.filter("gender IS NOT NULL AND size(schools) > 0").select(entity, "canonical_name", F.explode("matches").alias("m")).select(entity, "canonical_name", F.col("m.page").alias("page"), F.col("m.categories").alias("categories"))
    open_ = open_.join(reviewed.select("canonical_name", "page").distinct(), ["canonical_name", "page"], "left_anti")
    low = F.transform(F.coalesce("categories", F.array().cast("array<string>")), F.lower)
    pages = open_.groupBy(entity).agg(F.array_sort(F.collect_set("page")).alias("pages"), F.collect_list(low).alias("_page_categories"))
    teams = entries.filter("gender IS NOT NULL").select(entity, "gender", F.explode("schools").alias("name")).join(schools.filter("category IS NOT NULL"), "name")
    expected = teams.groupBy(entity).agg(F.array_sort(F.collect_set(team_category(F.col("category"), F.col("men_nickname"), F.col("women_nickname"), F.col("gender")))).alias("expected"))
    out = entries.select(entity, "canonical_name").join(pages, entity).join(expected, entity)
    wanted = F.transform("expected", F.lower)
    covered = F.exists("_page_categories", lambda p: F.size(F.array_except(wanted, p)) == 0)
    return out.filter(~covered).select(entity, "canonical_name", "pages", "expected")


def school_state(found: Column) -> Column:
    """``resolved`` by one match, ``ambiguous`` by several, ``fallback`` without any."""
    n = F.size(F.array_distinct(F.coalesce(found, F.array())))
    return F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("fallback")

