"""How sources of a language differ: divergences of all pairs of sources, and the terms that set a source apart.

Terms are runs of letters; a language keeps those of at least three of its documents. All shares are whole numbers in
billionths, add-one smoothed, and all arithmetic is exact. Divergences of pairs are sparse: a pair begins with what it
would be if no term occurred in either (a baseline that is one value for all terms), and only occurring terms correct
it: a group's own terms through a histogram of their shares, terms that both groups have through a join on the term.
The terms of a group are ranked by radix selection.

Null text, language and source count as ''. A group without kept terms has no `term` rows and takes part in pairs; a
language without kept terms has pairs of value 0. A group of its own language alone has no pairs. Repeated rows are
documents of their own. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.radix_select import greatest
from tallyloom.llm.shared import as_bytes, remove, slices, small_batches, spread_join, written
from tallyloom.llm.words import words

#: ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` after lower-casing A-Z, on UTF-8: letters and all bytes beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
UNIT = 1_000_000_000
#: Counts that a worker gathers before it passes them on.
MOST_HELD = 200_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, tf, df) summed over stretches of rows; one row of a null term for each group seen."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (tf, df) in held.items():
            terms, n = [None, *tf], len(tf) + 1
            for i in range(0, n, 20_000):
                part = terms[i : i + 20_000]
                columns = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                counts = [pa.array([c.get(t, 0) for t in part], pa.int64()) for c in (tf, df)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(part, pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "tf", "df"])
        held.clear()

    for rows in slices(batches, "_text", 4 << 20):
        size = 0
        for lang, source, text in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), as_bytes(rows.column("_text")), strict=True):
            tf, df = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for part in words(text, TERM):
                tf.update(part)
                seen.update(part)
            df.update(seen)
        size = sum(len(tf) for tf, _ in held.values())
        if size > MOST_HELD:
            yield from out()
    yield from out()


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(UNIT (count + 1) / (n + v)); null where n + v is zero."""
    return F.expr(f"1L + ((CAST({count} AS DECIMAL(20,0)) + 1) * {UNIT}) DIV nullif({n} + {v}, 0)")


def term(p: str, q: str) -> str:
    """floor((p - q)^2 / q), as SQL; shares are up to UNIT + 1, so that it fits a long."""
    return f"(({p} - {q}) * ({p} - {q})) DIV {q}"


def exact_sum(value: str) -> Column:
    return F.sum(F.expr(f"CAST({value} AS DECIMAL(20,0))"))


def pairs(held: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each group and each other source of its language.

    held is (lang, source, term, p, p0), groups (lang, source, v, p0), p0 being the share of a term that doesn't occur.
    """
    a, b = groups.select("lang", "source", "v", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    other = a.join(b, "lang").filter("source <> item")
    base = other.select("lang", "source", "item", F.expr(f"CAST(v AS DECIMAL(20,0)) * coalesce({term('p0', 'q0')}, 0)").cast("decimal(38,0)").alias("value"))
    shares = held.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n")).join(b, "lang").filter("source <> item")
    both = lambda to, back: F.expr(f"stack(2, source, item, CAST(n AS DECIMAL(18,0)) * ({to}), item, source, CAST(n AS DECIMAL(18,0)) * ({back})) AS (source, item, value)")
    single = shares.select("lang", both(f"{term('p', 'q0')} - {term('p0', 'q0')}", f"{term('q0', 'p')} - {term('q0', 'p0')}"))
    mine = held.select("lang", "term", "source", "p", "p0")
    theirs = held.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    met = mine.join(theirs, ["lang", "term"]).filter("source < item")
    to = f"{term('p', 'q')} - {term('p', 'q0')} - {term('p0', 'q')} + {term('p0', 'q0')}"
    back = f"{term('q', 'p')} - {term('q', 'p0')} - {term('q0', 'p')} + {term('q0', 'p0')}"
    shared = met.groupBy("lang", "source", "item").agg(exact_sum(to).alias("to"), exact_sum(back).alias("back"))
    shared = shared.select("lang", F.expr("stack(2, source, item, to, item, source, back) AS (source, item, value)"))
    wide = [x.withColumn("value", F.col("value").cast("decimal(38,0)")) for x in (base, single, shared)]
    return wide[0].unionByName(wide[1]).unionByName(wide[2]).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` and `term` of every (lang, source) group that occurs.

    value of a pair is the sum of floor((p - q)^2 / q) over the language's kept terms, p being the group's share and q
    the item's; that of a term is it against the language's share q, for terms of the group with p > q, of which the
    ``most_terms`` greatest are given. Greater values rank first, then smaller items by their UTF-8 bytes.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("_text"))
    counts = rows.mapInArrow(_counted, "lang string, source string, term string, tf long, df long")
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")), "term-counts")
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("tf").alias("all"), F.sum("df").alias("df")).filter(F.col("df") >= least_documents).drop("df")
    terms = written(terms, "kept-terms")
    kept = written(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "tf", "all"), "kept-counts")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("all_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n"), F.count("*").alias("rows"))
    groups = counts.filter("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "rows", "v", "all_n"])
    groups = written(groups.withColumn("p0", share("0", "n", "v")), "groups")
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    held = spread_join(kept, groups, ["lang", "source"], "rows", total)
    held = written(held.select("lang", "source", "term", share("tf", "n", "v").alias("p"), "p0", share("all", "all_n", "v").alias("q")), "term-shares")
    for used in (counts, terms, kept):
        remove(used, spark)
    apart = held.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(term("p", "q")).alias("value"))
    best = greatest(apart, ["lang", "source"], "value", "item", most_terms)
    own = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs(held, groups).withColumn("rank", F.row_number().over(own).cast("int"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(columns).unionByName(best.withColumn("part", F.lit("term")).select(columns))
