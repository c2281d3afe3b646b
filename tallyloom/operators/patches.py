"""Ordered corrections as steps from DataFrame to DataFrame. Patch tables are small, curated files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.stages import kept


def matched(key: list[str]) -> Column:
    """Rows whose key is that of the columns with an underscore before, nulls matching nulls."""
    on: Column = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return on


def first_patch(patches: DataFrame, key: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One patch a key: the first in file order; without an ordinal any one of them, the least."""
    order = F.col(ordinal) if ordinal in patches.columns else F.struct(*[c for c in patches.columns if c not in key])
    return patches.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_first = 1").drop("_first")


def fold(df: DataFrame, patches: DataFrame, key: list[str], state: list[str], step: Callable[[Column, Column], Column]) -> DataFrame:
    """Applies each row's patches one after another, by ``ordinal``, to its columns ``state``.

    Patches of a key (nulls match nulls) travel as one array; step(state, patch) gives the next state, a struct of the
    same columns. A later patch thus sees what an earlier one has set, and nothing that it doesn't set is lost.
    """
    rest = [F.col(c) if not isinstance(patches.schema[c].dataType, T.MapType) else F.map_entries(c).alias(c) for c in patches.columns if c not in [*key, "ordinal"]]
    own = patches.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.array_sort(F.collect_list(F.struct("ordinal", *rest))).alias("_patches"))
    joined = df.join(own, matched(key), "left")
    kind = joined.schema["_patches"].dataType.simpleString()
    out = F.aggregate(F.coalesce("_patches", F.array().cast(kind)), F.struct(*[F.col(c) for c in state]), step)
    return joined.withColumn("_state", out).select(*[F.col("_state")[c].alias(c) if c in state else F.col(c) for c in df.columns])


def remove_rows(df: DataFrame, patches: DataFrame, key: list[str], optional: list[str] = ()) -> DataFrame:
    """Drops matching rows; an optional column that a patch leaves null matches anything."""
    p = patches.select(*[F.col(c).alias(f"_{c}") for c in [*key, *optional]])
    on: Column = F.lit(True)
    for c in key:
        on = on & (F.col(c) == F.col(f"_{c}"))
    for c in optional:
        on = on & (F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}")))
    return df.join(p, on, "left_anti")


def update_rows(df: DataFrame, patches: DataFrame, key: list[str], values: dict[str, str], match: dict[str, str] | None = None, optional: dict[str, str] | None = None) -> DataFrame:
    """Sets columns from a patch's columns where these aren't null, one patch after another.

    A patch applies to rows of its key (nulls match nulls) whose columns in ``match`` are what its own columns say, nulls
    included, as they are by then; in ``optional``, a null of the patch matches anything.
    """
    match, optional = match or {}, optional or {}
    state = list(dict.fromkeys([*values, *match, *optional]))

    def step(now: Column, patch: Column) -> Column:
        applies: Column = F.lit(True)
        for c, of in match.items():
            applies = applies & now[c].eqNullSafe(patch[of].cast(df.schema[c].dataType))
        for c, of in optional.items():
            applies = applies & (patch[of].isNull() | now[c].eqNullSafe(patch[of].cast(df.schema[c].dataType)))
        return F.struct(*[(F.when(applies & patch[values[c]].isNotNull(), patch[values[c]].cast(df.schema[c].dataType)).otherwise(now[c]) if c in values else now[c]).alias(c) for c in state])

    return fold(df, patches, key, state, step)


def correct(df: DataFrame, patches: DataFrame, key: list[str], optional: list[str] = (), corrections: str = "corrections") -> DataFrame:
    """Sets arbitrary columns from a map of column to text, one patch after another; a null in the map sets null.

    Key and ``optional`` columns are matched as they are by then (nulls of the key match nulls, a null in ``optional``
    matches anything), so that a row whose key is corrected meets the later patches of its new key and none of its old
    one. A column that df lacks fails the job.
    """
    state = df.columns
    changes_key = F.arrays_overlap(F.map_keys(corrections), F.array(*map(F.lit, key)))
    moves = not patches.filter(changes_key).isEmpty()

    def step(now: Column, patch: Column) -> Column:
        new = F.map_from_entries(patch[corrections])
        unknown = F.filter(F.map_keys(new), lambda c: ~c.isin(*df.columns))
        failed = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("no such column to correct: "), F.get(unknown, F.lit(0)))).cast("boolean")).otherwise(F.lit(True))
        applies: Column = failed & (patch["ordinal"] > F.coalesce(now["_since"], F.lit(-(1 << 62))))
        for c in key:
            applies = applies & now[c].eqNullSafe(now[f"_key_{c}"])
        for c in optional:
            applies = applies & (patch[c].isNull() | F.coalesce(now[c] == patch[c], F.lit(False)))
        has = lambda c: applies & F.coalesce(F.map_contains_key(new, F.lit(c)), F.lit(False))
        set_ = [F.when(has(c), F.try_element_at(new, F.lit(c)).try_cast(df.schema[c].dataType)).otherwise(now[c]).alias(c) for c in state]
        moved = F.lit(False)
        for c in key:
            moved = moved | has(c)
        return F.struct(*set_, F.when(moved, patch["ordinal"].cast("long")).otherwise(now["_since"]).alias("_since"), *[now[f"_key_{c}"].alias(f"_key_{c}") for c in key])

    keys = [f"_key_{c}" for c in key]
    at = patches.withColumnsRenamed({c: f"_key_{c}" for c in key})
    rows = df.withColumn("_since", F.lit(None).cast("long")).withColumns({f"_key_{c}": F.col(c) for c in key})
    for _ in range(patches.count() if moves else 1):
        rows = fold(rows, at, keys, [*state, "_since", *keys], step)
        if not moves:
            break
        rows = kept(rows)
        now: Column = F.lit(True)
        for c in key:
            now = now & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
        if rows.filter(~now).isEmpty():
            break
        # What has another key by now meets that key's patches that come after the one that gave it.
        rows = rows.withColumn("_since", F.when(now, F.lit(1 << 62)).otherwise(F.col("_since"))).withColumns({f"_key_{c}": F.col(c) for c in key})
    return rows.select(*df.columns)


def upsert(df: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Rows of patches replace those of the same key; those of new keys are added. Both have df's columns."""
    p = patches.withColumn("_last", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ordinal")))).filter("_last = 1")
    return df.join(p, key, "left_anti").unionByName(p.select(*df.columns))


def upsert_places(df: DataFrame, patches: DataFrame, key: list[str], identifier: str, place: str, name: str, flags: list[str], sentinel: int = 999, unresolved: tuple[str, ...] = ("skip", "tie"), whole_team: str = "Relay member unknown", legs: int = 4) -> DataFrame:
    """Places for rows that lack one: of the rows of a patch's key (name among it), the one of the least identifier gets
    the place, and its flags become 0, if its own is the sentinel; any other place stays. A key without rows is inserted.

    Patches without a name, or of a name in ``unresolved``, do nothing; of several patches of a key the first counts,
    as the others find its row. A null in a patch's key meets no row, so that each such patch is inserted. Only rows of
    the patches' keys are aggregated. A patch of the whole team without ``leg_idx`` is inserted once for each leg.
    """
    wanted = patches.filter(F.col(name).isNotNull() & ~F.col(name).isin(*unresolved))
    whole: Column = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    p = first_patch(wanted.filter(whole), key).unionByName(wanted.filter(~whole))
    have = df.join(p.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.min(identifier).alias("_row"))
    hits = have.join(p.select(*key, F.col(place).alias("_place")), key).select("_row", "_place")
    changed = df.join(hits, F.col(identifier) == F.col("_row"), "left").withColumn("_set", F.col("_row").isNotNull() & F.coalesce(F.col(place) == sentinel, F.lit(False)))
    new = {place: F.col("_place").cast(df.schema[place].dataType)} | {c: F.lit(0).cast(df.schema[c].dataType) for c in flags}
    have_place = changed.select(*[F.when(F.col("_set"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])
    added = p.join(have, key, "left_anti")
    team = (F.col(name) == whole_team) & F.coalesce(F.col("is_relay"), F.lit(False)) & F.col("leg_idx").isNull()
    added = added.withColumn("leg_idx", F.explode(F.when(team, F.sequence(F.lit(1), F.lit(legs))).otherwise(F.array(F.col("leg_idx").cast("int")))))
    fill = lambda c: F.lit(0) if c in flags else F.col(c) if c in added.columns else F.lit(None)
    return have_place.unionByName(added.select(*[fill(c).cast(df.schema[c].dataType).alias(c) for c in df.columns]))


def insert_missing(df: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Adds the patches whose key df lacks; of several of one key the first counts. Nulls of a key match nulls."""
    p = first_patch(patches, key)
    have = df.join(p.select(*[F.col(c).alias(f"_{c}") for c in key]), matched(key), "left_semi").select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    return df.unionByName(p.join(have, matched(key), "left_anti").select(*df.columns))


def import_entries(df: DataFrame, entries: DataFrame, team: list[str], school: str = "school", place: str = "place", name: str = "name", leg: str = "leg_idx", relay: str = "is_relay", skip: str = "skip", unknown: str = "Relay member unknown") -> DataFrame:
    """Rows of a file of missing entries that df lacks, one entry after another by ``ordinal``; see below.

    Entries to skip go, and those without a name unless they are of a relay and have a school. Such a one stands for an
    unknown member: it is added if df has no unknown member of its ``team`` columns, school, place and leg (nulls alike).
    A named relay entry with a leg takes the place of the unknown member there, and is added like any other named entry
    if df has no row of its name, school, place and team columns; a null among these meets nothing, so that such an entry
    is always added. Of several alike the first counts. Entries have df's columns, ordinal and skip.
    """
    slot, same = [*team, school, place, leg], [name, *team, school, place]
    rows = entries.filter(~F.coalesce(F.col(skip), F.lit(False)))
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    holes = first_patch(rows.filter(blank & F.coalesce(F.col(relay), F.lit(False)) & (F.coalesce(school, F.lit("")) != "")).withColumn(name, F.lit(unknown)), slot)
    named = rows.filter(~blank)
    taken = named.filter(F.coalesce(F.col(relay), F.lit(False)) & F.col(leg).isNotNull()).groupBy(*[F.col(c).alias(f"_{c}") for c in slot]).agg(F.max("ordinal").alias("_last"))
    is_hole = F.col(name) == unknown
    # Unknown members of df whose slot an entry names go; one that an entry adds later than that stays.
    left = df.join(taken, matched(slot) & is_hole, "left_anti")
    had = df.filter(is_hole).join(holes.select(*[F.col(c).alias(f"_{c}") for c in slot]), matched(slot), "left_semi").select(*[F.col(c).alias(f"_{c}") for c in slot], F.lit(True).alias("_had")).distinct()
    last_hole = rows.filter(blank).groupBy(*[F.col(c).alias(f"_{c}") for c in slot]).agg(F.max("ordinal").alias("_hole"))
    holes = holes.join(taken, matched(slot), "left").drop(*[f"_{c}" for c in slot]).join(had, matched(slot), "left").drop(*[f"_{c}" for c in slot]).join(last_hole, matched(slot), "left")
    added = holes.filter(F.when(F.col("_last").isNull(), F.col("_had").isNull()).otherwise(F.col("_hole") > F.col("_last"))).select(*df.columns)
    whole: Column = F.lit(True)
    for c in same:
        whole = whole & F.col(c).isNotNull()
    new = first_patch(named.filter(whole), same).join(df.join(named.select(*same).distinct(), same, "left_semi").select(*same).distinct(), same, "left_anti").select(*df.columns)
    return left.unionByName(added).unionByName(new).unionByName(named.filter(~whole).select(*df.columns))


def replace_groups(df: DataFrame, members: DataFrame, key: list[str], name: str | None = None, unresolved: str = "skip", unknown: str = "Unknown") -> DataFrame:
    """Groups that members has (nulls of the key match nulls) are replaced by its rows.

    With a name column, a group of which some member has no name yet is left alone, and one that is ``unresolved`` is
    called ``unknown``.
    """
    if name is not None:
        open_ = members.filter(F.col(name).isNull()).select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
        members = members.join(open_, matched(key), "left_anti").withColumn(name, F.when(F.col(name) == unresolved, F.lit(unknown)).otherwise(F.col(name)))
    groups = members.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    return df.join(groups, matched(key), "left_anti").unionByName(members.select(*df.columns))


def keep_places(df: DataFrame, cases: DataFrame, key: list[str], place: str) -> DataFrame:
    """Near duplicates: a case keeps one place (rows of others, and without one, go), "both", "neither", or is open."""
    c = first_patch(cases, key).select(*[F.col(k).alias(f"_{k}") for k in key], "keep")
    on = matched(key)
    keep = F.col("keep")
    stays = keep.isNull() | (keep == "both") | ((keep != "neither") & F.coalesce(F.col(place).cast("string") == keep, F.lit(False)))
    return df.join(c, on, "left").filter(stays).select(*df.columns)


def audit(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """How many rows a step inserted, deleted, changed and left alone; key is unique on both sides."""
    rest = [c for c in before.columns if c not in key]
    a = before.select(*key, F.struct(*rest).alias("_a"), F.lit(1).alias("_in_a"))
    b = after.select(*key, F.struct(*rest).alias("_b"), F.lit(1).alias("_in_b"))
    action = F.when(F.col("_in_a").isNull(), "inserted").when(F.col("_in_b").isNull(), "deleted").when(F.col("_a").eqNullSafe(F.col("_b")), "kept").otherwise("updated")
    return a.join(b, key, "full").groupBy(action.alias("action")).agg(F.count("*").alias("n"))
