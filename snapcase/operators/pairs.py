"""Sparse association of item pairs (C15-C19 without the grid of all pairs).

Only pairs that can matter are formed:

* pairs that occur together in a basket are counted; a basket with more than ``CELL``
  items on a side is cut into a grid of cells, so no task gets a heavy basket whole;
* a pair that never occurs together is significant only where both items are frequent:
  from a frequency of X follows the least frequency of Y, and a join through frequency
  buckets lists just those pairs;
* the largest V cannot exceed a bound that depends on the two frequencies alone.  The
  best k are sought first among pairs with a high bound; the kth V found there then
  leaves out every pair whose bound is lower.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcase.functions.stats import CHISQ1_95, yates_chisq
from snapcase.operators.association import assoc_topk, cramers_v
from snapcase.operators.episodes import BOOKING
from snapcase.session import results_path

# Items of one side of a basket that meet the other side in one task.
CELL = 512
# Frequency buckets in each doubling.
FINENESS = 4
# Bounds are floating-point sums; a pair is left out only if clearly below.
SLACK = 1 + 1e-9


def _sides(x_group: str, y_group: str) -> tuple[Column, Column]:
    return F.col("grp") == x_group, F.col("grp") == y_group


def co_occurrences(items: DataFrame, keys: Sequence[str], x_group: str, y_group: str,
                   cell: int = CELL, codes: Sequence[int] | None = None) -> DataFrame:
    """Baskets that hold both items, for the pairs that occur: x_item, y_item, n11.

    ``items`` has distinct rows (keys, item, grp).  The X items of a basket are dealt to
    ``px`` parts and its Y items to ``py``; each part of one side is copied to the parts of
    the other, so a basket of any size is spread over px * py cells of at most about
    ``cell`` x ``cell`` pairs.  Most baskets are one cell.  With ``codes``, ``items`` has a
    column ``bucket`` and only pairs of buckets with these codes are counted.
    """
    keys = list(keys)
    is_x, is_y = _sides(x_group, y_group)
    # Baskets with items of one side only form no pair.
    sizes = items.groupBy(*keys).agg(
        F.ceil(F.count_if(is_x) / cell).cast("int").alias("px"),
        F.ceil(F.count_if(is_y) / cell).cast("int").alias("py")).filter("px > 0 AND py > 0")
    placed = items.join(sizes.hint("merge"), keys)
    own = F.xxhash64("item")
    extra = [] if codes is None else ["bucket"]

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    xs = (placed.filter(is_x).withColumn("i", F.pmod(own, "px").cast("int")).withColumn("j", every("py"))
          .select(*keys, "i", "j", F.col("item").alias("x_item"), *(F.col(c).alias("bx") for c in extra)))
    ys = (placed.filter(is_y).withColumn("j", F.pmod(own, "py").cast("int")).withColumn("i", every("px"))
          .select(*keys, "i", "j", F.col("item").alias("y_item"), *(F.col(c).alias("by") for c in extra)))
    met = xs.join(ys.hint("merge"), [*keys, "i", "j"])
    if codes is not None:
        met = met.filter(_code(F.col("bx"), F.col("by")).isin(list(codes)))
    return met.groupBy("x_item", "y_item").agg(F.count(F.lit(1)).alias("n11"))


def marginals(items: DataFrame, x_group: str, y_group: str) -> tuple[DataFrame, DataFrame]:
    """(x_item, mx) and (y_item, my): baskets that hold each item."""
    is_x, is_y = _sides(x_group, y_group)
    return (items.filter(is_x).groupBy(F.col("item").alias("x_item")).agg(F.count(F.lit(1)).alias("mx")),
            items.filter(is_y).groupBy(F.col("item").alias("y_item")).agg(F.count(F.lit(1)).alias("my")))


def basket_count(items: DataFrame, keys: Sequence[str]) -> Column:
    """Number of baskets, as a scalar subquery."""
    return items.select(*keys).distinct().agg(F.count(F.lit(1))).scalar().cast("long")


def _bucket(m: Column) -> Column:
    return F.floor(F.log2(m.cast("double")) * FINENESS).cast("int")


def _code(bx, by):
    """One number for a pair of buckets."""
    return bx * 1000 + by


def zero_candidates(mx: DataFrame, my: DataFrame, n: Column, least_chi2: float = CHISQ1_95) -> DataFrame:
    """Pairs whose chi-square is above ``least_chi2`` if they never occur together: x_item, y_item, mx, my.

    With n11 = 0 the corrected statistic grows with both frequencies, so for each X item
    there is a least frequency of Y: the larger root of a quadratic in my / n.
    """
    c = F.lit(float(least_chi2))
    nd = n.cast("double")
    p = F.col("mx") / nd
    spread = c * nd * p * (1 - p)
    a, b = nd * nd * p * p + spread, nd * p + spread
    # A little lower, because of rounding; the statistic itself decides below.
    least = nd * (b + F.sqrt(F.greatest(F.lit(0.0), b * b - a))) / (2 * a) * (1 - 1e-9)
    top = my.agg(F.max(_bucket(F.col("my")))).scalar()
    from_x = (mx.withColumn("least", F.greatest(F.lit(1.0), least))
              .withColumn("from", _bucket(F.col("least"))).filter(F.col("from") <= top)
              .withColumn("bucket", F.explode(F.sequence(F.col("from"), top))))
    met = from_x.join(my.withColumn("bucket", _bucket(F.col("my"))), "bucket").filter("my >= least")
    chi2 = yates_chisq(F.lit(0), F.col("mx"), F.col("my"), n)
    return met.filter(chi2 > c).select("x_item", "y_item", "mx", "my")


def _tables(n11: DataFrame, n: Column) -> DataFrame:
    """2x2 counts of rows (x_item, y_item, mx, my, n11), named as in ``item_pair_contingency``."""
    return n11.select(
        "x_item", "y_item", F.col("n11").cast("long").alias("n11"),
        (F.col("mx") - F.col("n11")).cast("long").alias("n10"),
        (F.col("my") - F.col("n11")).cast("long").alias("n01"),
        (n - F.col("mx") - F.col("my") + F.col("n11")).cast("long").alias("n00"), n.alias("n"))


def significant_pairs(items: DataFrame, keys: Sequence[str], x_group: str, y_group: str,
                      cell: int = CELL, only: DataFrame | None = None) -> DataFrame:
    """Every pair with a significant V, and no other: the 2x2 counts, chi2, p_value, cramers_v.

    ``only`` (item, grp) restricts the pairs to some items; the baskets stay the same.
    """
    n = basket_count(items, keys)
    if only is not None:
        items = items.join(only, ["item", "grp"], "left_semi")
    mx, my = marginals(items, x_group, y_group)
    n11 = co_occurrences(items, keys, x_group, y_group, cell)
    together = n11.join(mx, "x_item").join(my, "y_item")
    apart = (zero_candidates(mx, my, n).join(n11, ["x_item", "y_item"], "left_anti")
             .withColumn("n11", F.lit(0).cast("long")))
    cells = together.select("x_item", "y_item", "mx", "my", "n11").unionByName(apart)
    return cramers_v(_tables(cells, n)).filter("cramers_v IS NOT NULL")


def range_bound(x: tuple[int, int], y: tuple[int, int], n: int) -> float:
    """The largest V of any two frequencies out of two ranges (low, high).

    With all of the rarer item inside the commoner one the uncorrected V is the square root
    of a ratio of odds, which is largest where the ranges come closest.  With as little
    overlap as possible it grows with both frequencies while they fit side by side.
    """
    def odds(m: int) -> float:
        return m / (n - m) if m < n else math.inf

    if x[1] < y[0]:
        inside = odds(x[1]) / odds(y[0])
    elif y[1] < x[0]:
        inside = odds(y[1]) / odds(x[0])
    else:
        inside = 1.0
    apart = min(1.0, odds(x[1]) * odds(y[1])) if x[1] + y[1] <= n else 1.0
    return math.sqrt(max(inside, apart)) * SLACK


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = results_path(df.sparkSession, f"pairs/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def top_pairs(items: DataFrame, keys: Sequence[str] = BOOKING, x_group: str = "DRUGS",
              y_group: str = "TRAFFIC", k: int = 20, cell: int = CELL, first: float = 0.5) -> DataFrame:
    """The k largest significant V (as ``assoc_topk``), best bounds first.

    Frequencies are put into buckets, of which at most a few hundred rows reach the driver.
    Pairs of buckets with a bound of at least ``first`` are evaluated first; of the others
    only those whose bound reaches the kth V found so far.  Pairs that never occur together
    are listed last, those that reach the kth V.
    """
    keys = list(keys)
    mx, my = (_stored(m, name) for m, name in zip(marginals(items, x_group, y_group), ("mx", "my")))
    total = items.select(*keys).distinct().count()
    n = F.lit(total).cast("long")
    ranges = [{r.b: (r.lo, r.hi) for r in m.groupBy(_bucket(F.col(c)).alias("b")).agg(
        F.min(c).alias("lo"), F.max(c).alias("hi")).collect()} for m, c in ((mx, "mx"), (my, "my"))]
    bounds = {(bx, by): range_bound(x, y, total) for bx, x in ranges[0].items() for by, y in ranges[1].items()}
    floor = math.sqrt(CHISQ1_95 / total) if total else 1.0
    bucketed = mx.select(F.col("x_item").alias("item"), F.lit(x_group).alias("grp"),
                         _bucket(F.col("mx")).alias("bucket")).unionByName(
        my.select(F.col("y_item").alias("item"), F.lit(y_group).alias("grp"),
                  _bucket(F.col("my")).alias("bucket")))

    def best(v: DataFrame) -> DataFrame:
        order = [F.col("cramers_v").desc(), F.col("x_item"), F.col("y_item")]
        return (v.filter("cramers_v IS NOT NULL").select("x_item", "y_item", "cramers_v")
                .orderBy(*order).limit(k))

    def together(open_: list[tuple[int, int]]) -> DataFrame:
        """The best k of the pairs of these buckets that occur together."""
        of_x, of_y = (sorted({pair[side] for pair in open_}) for side in (0, 1))
        wanted = bucketed.filter(((F.col("grp") == x_group) & F.col("bucket").isin(of_x))
                                 | ((F.col("grp") == y_group) & F.col("bucket").isin(of_y)))
        n11 = co_occurrences(items.join(wanted, ["item", "grp"]), keys, x_group, y_group, cell,
                             [_code(*pair) for pair in open_])
        pairs = n11.join(mx, "x_item").join(my, "y_item")
        return best(cramers_v(_tables(pairs, n)))

    def kth(v: DataFrame) -> float:
        row = v.agg(F.min("cramers_v").alias("v"), F.count(F.lit(1)).alias("n")).first()
        return max(floor, row.v) if row.n >= k else floor

    found = _stored(together([pair for pair, v in bounds.items() if v >= first]), "first")
    low = kth(found)
    rest = [pair for pair, v in bounds.items() if low <= v < first]
    if rest:
        found = _stored(best(found.unionByName(together(rest))), "rest")
        low = kth(found)
    least = max(CHISQ1_95, low * low * total / SLACK ** 2)
    # A little less than the kth, so that ties with it are listed as well.
    candidates = _stored(zero_candidates(mx, my, n, min(least, max(CHISQ1_95, least * (1 - 1e-9)))), "apart")
    if not candidates.isEmpty():
        of_pairs = candidates.select(F.explode(F.array(
            F.struct(F.col("x_item").alias("item"), F.lit(x_group).alias("grp")),
            F.struct(F.col("y_item").alias("item"), F.lit(y_group).alias("grp")))).alias("i")).select("i.*")
        n11 = co_occurrences(items.join(of_pairs.distinct(), ["item", "grp"], "left_semi"), keys,
                             x_group, y_group, cell)
        apart = candidates.join(n11, ["x_item", "y_item"], "left_anti").withColumn("n11", F.lit(0))
        found = best(found.unionByName(best(cramers_v(_tables(apart, n)))))
    return assoc_topk(found, k)
