"""Filter interaction audit: what each of some filters removes, alone, after others, and on average over all orders.

Every document is reduced to the set of filters that it fails, a mask, and documents are counted by part and mask; nothing after that
grows with the corpus. The counts of a part make its removal polynomial, the multilinear extension of the number of removed
documents: R(x) is the number that is expected to go if filter i is in use with probability x_i. With n_m documents of mask m

    R(x) = sum_m n_m (1 - prod_{i in m} (1 - x_i)) = sum_S c_S prod_{i in S} x_i,   c_S = (-1)^(|S|+1) sum_{m contains S} n_m.

At a corner, every x_i 0 or 1, R is what that set of filters removes, so all orders and steps are differences of corners. The Shapley
value of filter i is the integral of its partial derivative along the diagonal,

    int_0^1 dR/dx_i (t, .., t) dt = sum_{S contains i} c_S / |S|,

a rational number whose denominator divides lcm(1 .. k). It is kept as a numerator over that denominator, so that its k! -fold, what
the filter removes summed over all orders, is exact.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Orders of so many filters are listed: 720.
MOST_FILTERS = 6
MEASURES = ("n", "good", "toxic")

# What stands between words, and the limits of the filters.
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = "[#$%&*|]"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: A few words, B repeated words, C capitals, D signs. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT,
        "C": (F.length(text) - F.length(F.translate(text, _UPPER, ""))) * 100 > F.length(text) * MAX_UPPER,
        "D": text.rlike(_SIGNS),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, good, toxic) of every row of ``docs``. Bit k of the mask says that filter k of ABCDE fails: the four of
    ``text_filters`` and E, a text that a smaller id has.

    The first id of a text comes from an aggregation of digests that combines before its shuffle, and finds its row by digest *and* id:
    copies of one text, however many, never meet in one task. A null id is smaller than none and has none smaller; it never fails E.
    Rows with one id and one text fail E alike. A null part is the empty string. A document is good (toxic) if any row of
    ``labels`` with its id says so; labels without an id are no one's. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = [F.when(fails, F.lit(1 << k)).otherwise(0) for k, fails in enumerate(text_filters(F.col("text")).values())]
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("bits"))
    first = docs.select(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"), F.col(id_col).alias("id"))
    first = first.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("_first", F.lit(True))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    said = said.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    copy = F.when(F.col("id").isNotNull() & F.col("_first").isNull(), F.lit(16)).otherwise(0)
    found = rows.join(first, ["digest", "id"], "left").join(said, "id", "left")
    return found.select("id", "part", (F.col("bits") + copy).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def mask_counts(found: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) from ``masks``; combines before the shuffle, so a part may hold any share of the rows."""
    return found.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic"))


def _sets(k: int, least: int = 0) -> Column:
    return F.sequence(F.lit(least), F.lit((1 << k) - 1))


def _sum(over: Column, term) -> Column:
    return F.aggregate(over, F.lit(0).cast("long"), lambda total, x: total + term(x))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def polynomials(counts: DataFrame, k: int) -> DataFrame:
    """(part, total, c): the part's documents, and its removal polynomials: c.<measure>[S] is the coefficient of the product of the x_i
    of S, the filters of S as bits. One row a part, 2^k numbers a measure, from at most as many rows of ``counts``."""
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("m"))

    def coefficients(measure: str) -> Column:
        holding = lambda s: _sum(F.col("m"), lambda m: F.when(m["mask"].bitwiseAND(s) == s, m[measure]).otherwise(0))
        return F.transform(_sets(k), lambda s: F.when(s == 0, F.lit(0).cast("long")).when(F.bit_count(s) % 2 == 1, holding(s)).otherwise(-holding(s)))

    return parts.select("part", _sum(F.col("m"), lambda m: m["n"]).alias("total"), F.struct(*[coefficients(m).alias(m) for m in MEASURES]).alias("c"))


def corners(coefficients: Column, k: int) -> Column:
    """The polynomial's value at each corner, an array by the set of filters in use: what that set removes."""
    return F.transform(_sets(k), lambda t: _sum(_sets(k, 1), lambda s: F.when(s.bitwiseAND(t) == s, F.get(coefficients, s)).otherwise(0)))


def shapley(coefficients: Column, k: int) -> Column:
    """Array of the filters' Shapley values as numerators over lcm(1 .. k): the partial derivative along the diagonal,
    sum_S c_S t^(|S|-1), integrated term by term."""
    share = F.array(*[F.lit(math.lcm(*range(1, k + 1)) // n).cast("long") for n in range(1, k + 1)])
    term = lambda i: lambda s: F.when(s.bitwiseAND(1 << i) > 0, F.get(coefficients, s) * F.get(share, F.bit_count(s) - 1)).otherwise(0)
    return F.array(*[_sum(_sets(k, 1), term(i)) for i in range(k)])


def audit(counts: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, shapley_numerator,
    shapley_denominator) of every part, order of the filters ``names`` and step.

    ``shapley`` is the Shapley value times the number of orders, exactly; the two others are the value itself as a fraction. Without
    rows there is no part and no result.
    """
    k = len(names)
    whole, orders, all_ = math.lcm(*range(1, k + 1)), math.factorial(k), (1 << k) - 1
    parts = polynomials(counts, k)
    found = lambda c: F.struct(*[corners(c[m], k).alias(m) for m in MEASURES], shapley(c["n"], k).alias("value"))
    parts = parts.select("part", "total", _once(F.col("c"), found).alias("f")).select("part", "total", "f.*")
    every = parts.select("*", F.explode(_steps(names)).alias("s")).select("part", "total", *MEASURES, "value", "s.*")

    def gone(measure: str, used: Column) -> Column:
        return F.get(F.col(measure), used)

    here = lambda m: gone(m, F.col("after")) - gone(m, F.col("before"))
    bit = F.col("after") - F.col("before")
    value = F.get(F.col("value"), F.col("filter"))
    return every.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - gone("n", F.col("after"))).alias("kept"),
        here("n").alias("removed"),
        (gone("n", bit) - here("n")).alias("redundant"),
        (gone("n", F.lit(all_)) - gone("n", F.lit(all_) - bit)).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        (value * (orders // whole)).alias("shapley"),
        value.alias("shapley_numerator"),
        F.lit(whole).cast("long").alias("shapley_denominator"),
    )


def _steps(names: str) -> Column:
    """A constant: every order's steps, with the sets of filters in use before and after each."""
    listed = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order):
            listed.append({"filter_order": "".join(names[j] for j in order), "step": step + 1, "filter": i, "before": before, "after": before | 1 << i})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(listed)), "array<struct<filter_order: string, step: int, filter: int, before: int, after: int>>")


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(mask_counts(found), "ABCDE").select(*COLUMNS)


# Every order's steps are walked over the counts of masks; the mean over orders is their plain sum.
SQL = """
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, [x for x in string_split_regex(t, '[\\x20\\x09-\\x0D]+') if x <> ''] as words, min(doc_id) over (partition by t) as first_id from t),
f as (select doc_id, part, len(words) < 100 as a, 100 * len(list_distinct(words)) < 80 * len(words) as b,
             100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d, coalesce(doc_id > first_id, false) as e from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1),
m as (select part, [a, b, c, d, e] as fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by all),
k as (select unnest(range(1, 6)) as i),
o as (select [a.i, b.i, c.i, d.i, e.i] as ord from k a, k b, k c, k d, k e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select ord, i as step, ord[i] as fil, ord[:i - 1] as earlier from o, k),
p as (select distinct part from m),
r as (select p.part, s.ord, s.step, s.fil,
             sum(case when not m.fails[s.fil] and not list_bool_or([false] || [m.fails[x] for x in s.earlier]) then n else 0 end) as kept,
             sum(case when m.fails[s.fil] and not list_bool_or([false] || [m.fails[x] for x in s.earlier]) then n else 0 end) as removed,
             sum(case when m.fails[s.fil] and list_bool_or([false] || [m.fails[x] for x in s.earlier]) then n else 0 end) as redundant,
             sum(case when m.fails[s.fil] and len([x for x in m.fails if x]) = 1 then n else 0 end) as unique_fails,
             sum(case when m.fails[s.fil] and not list_bool_or([false] || [m.fails[x] for x in s.earlier]) then good else 0 end) as good_lost,
             sum(case when m.fails[s.fil] and not list_bool_or([false] || [m.fails[x] for x in s.earlier]) then toxic else 0 end) as toxic_lost
      from p join m using (part) cross join s group by all)
select part, array_to_string([substr('ABCDE', x, 1) for x in ord], '') as filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
       redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, fil))::bigint as shapley
from r
"""
