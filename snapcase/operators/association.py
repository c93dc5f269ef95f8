"""Basket association between two item groups (C14-C20).

A basket is an episode; items are charges; group X (e.g. drugs) is compared
with group Y (e.g. traffic) pair by pair through 2x2 tables over the baskets
that hold any item of either group.

Plan shape: ``distinct(basket, item)`` (partial aggregation, so a hot basket collapses
map-side to at most one row per item) -> X rows joined to Y rows on the basket, a heavy
basket in cells (``pairs.py``) -> ``groupBy(x, y).count()``.  The full tables below list
every pair and combine the two marginals part by part (``grid.py``); the significant pairs
and the top k need no such grid and are found in ``pairs.py``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcase.functions.stats import CHISQ1_95, chisq_upper_p, yates_chisq
from snapcase.functions.text import sentence_case
from snapcase.operators.episodes import BOOKING
from snapcase.operators.grid import combinations
from snapcase.session import shared_dir


def basket_items(df: DataFrame, groups: Sequence[str], basket: Sequence[str] = BOOKING,
                 item: str = "Charge", group_col: str = "ChargeGroup",
                 grain: str = "basket") -> DataFrame:
    """Distinct ``(basket..., item, grp)`` rows of the listed groups; a NULL item is no item.

    ``grain="item"`` reproduces the literal one-row-per-charge indicator
    frame: every (basket, item) is its own basket, so two different items
    never co-occur.
    """
    rows = df.filter(F.col(group_col).isin(list(groups)) & F.col(item).isNotNull())
    cols = [F.col(c) for c in basket]
    if grain == "item":
        cols.append(F.col(item).alias("_basket_item"))
    elif grain != "basket":
        raise ValueError("grain must be 'basket' or 'item'")
    return rows.select(*cols, F.col(item).alias("item"), F.col(group_col).alias("grp")).distinct()


def _basket_cols(basket: Sequence[str], grain: str) -> list[str]:
    return list(basket) + (["_basket_item"] if grain == "item" else [])


def indicator_matrix(df: DataFrame, items: Sequence[str], groups: Sequence[str],
                     basket: Sequence[str] = BOOKING, item: str = "Charge",
                     group_col: str = "ChargeGroup", grain: str = "basket") -> DataFrame:
    """Wide 0/1 frame: one row per basket, one column per listed item (C14).

    ``items`` must be given (the column set of a wide frame is part of its
    schema); the algorithms below use the long form instead.
    """
    bi = basket_items(df, groups, basket, item, group_col, grain)
    keys = _basket_cols(basket, grain)
    wide = bi.groupBy(*keys).pivot("item", list(items)).agg(F.count(F.lit(1)))
    out = wide.select(*[F.col(k) for k in keys],
                      *[F.when(F.col(f"`{i}`") > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
                        .alias(i) for i in items])
    if grain == "item":
        out = out.withColumnRenamed("_basket_item", item)
    return out


def item_pair_contingency(df: DataFrame, x_group: str, y_group: str,
                          basket: Sequence[str] = BOOKING, item: str = "Charge",
                          group_col: str = "ChargeGroup", grain: str = "basket",
                          zero_fill: bool = True,
                          checkpoint: bool = True, items: DataFrame | None = None) -> DataFrame:
    """2x2 counts for every (x item, y item) pair.

    Output: ``x_item, y_item, n11, n10, n01, n00, n`` where ``n`` is the
    number of baskets holding any item of either group.  With ``zero_fill``
    pairs that never co-occur are listed with ``n11 = 0`` (they can still be
    significant): |X| x |Y| rows, the size of the answer.  ``items`` takes the rows of
    :func:`basket_items` where they are written already.
    """
    bi = items if items is not None else basket_items(df, [x_group, y_group], basket, item, group_col,
                                                      grain)
    if checkpoint and items is None:
        # The distinct (basket, item) rows feed four consumers (pair join,
        # marginals, basket count, vocabulary): write them once to the shared
        # checkpoint folder so the snapshot table is scanned once.
        shared_dir(df.sparkSession)
        bi = bi.checkpoint(eager=True)
    from snapcase.operators import pairs
    keys = _basket_cols(basket, grain)
    n_baskets = pairs.basket_count(bi, keys)
    mx, my = pairs.marginals(bi, x_group, y_group)
    n11 = pairs.co_occurrences(bi, keys, x_group, y_group)
    if zero_fill:
        grid = combinations(mx, my)
        cells = grid.join(n11, ["x_item", "y_item"], "left") \
                    .withColumn("n11", F.coalesce(F.col("n11"), F.lit(0)))
    else:
        cells = n11.join(mx, "x_item").join(my, "y_item")
    n = n_baskets
    return cells.select(
        "x_item", "y_item", F.col("n11").cast("long").alias("n11"),
        (F.col("mx") - F.col("n11")).cast("long").alias("n10"),
        (F.col("my") - F.col("n11")).cast("long").alias("n01"),
        (n - F.col("mx") - F.col("my") + F.col("n11")).cast("long").alias("n00"),
        n.alias("n"))


def chisq_yates(pairs: DataFrame) -> DataFrame:
    """Add the continuity-corrected chi-square and its p-value."""
    mx = F.col("n11") + F.col("n10")
    my = F.col("n11") + F.col("n01")
    chi2 = yates_chisq(F.col("n11"), mx, my, F.col("n"))
    return pairs.withColumn("chi2", chi2).withColumn("p_value", chisq_upper_p(F.col("chi2"), 1))


def cramers_v(pairs: DataFrame) -> DataFrame:
    """Cramer's V of every pair, NULL unless p < 0.05 (C17).

    For 2x2 tables ``V = sqrt(chi2 / n)``; significance compares chi2 with
    the exact 0.95 quantile, so it does not depend on the p approximation.
    """
    t = chisq_yates(pairs) if "chi2" not in pairs.columns else pairs
    sig = F.col("chi2") > F.lit(CHISQ1_95)
    return t.withColumn("cramers_v",
                        F.when(sig, F.sqrt(F.col("chi2") / F.col("n").cast("double"))))


def assoc_matrix(v: DataFrame, x_items: Sequence[str]) -> DataFrame:
    """Y items as rows, X items as columns, cells V or NULL."""
    return v.groupBy("y_item").pivot("x_item", list(x_items)).agg(F.first("cramers_v"))


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    # Global row_number: only ever applied to an already limited result.
    return df.withColumn("id", F.row_number().over(Window.orderBy(*order)).cast("long"))


def assoc_topk(v: DataFrame, k: int = 20) -> DataFrame:
    """The k largest significant V with rank ``id``.

    Ties: X item, then Y item.  ``limit`` after ``orderBy`` plans as a
    per-partition top-k followed by one merge of k rows per partition.
    """
    order = [F.col("cramers_v").desc(), F.col("x_item"), F.col("y_item")]
    top = v.filter(F.col("cramers_v").isNotNull()).orderBy(*order).limit(k)
    return _ranked(top, order).select(
        "id", F.col("y_item").alias("traffic_charge"), F.col("x_item").alias("drug_charge"),
        "cramers_v")


def assoc_topk_cross(v: DataFrame, k: int = 20, digits: int = 5, top: DataFrame | None = None) -> DataFrame:
    """Literal variant (C19): every significant cell in the rows x columns
    touched by the top k, V rounded, re-ranked.  Bounded by k^2 cells."""
    top = assoc_topk(v, k) if top is None else top
    cols = top.select(F.col("drug_charge").alias("x_item")).distinct()
    rows = top.select(F.col("traffic_charge").alias("y_item")).distinct()
    cells = (v.filter(F.col("cramers_v").isNotNull())
              .join(F.broadcast(cols), "x_item", "left_semi")
              .join(F.broadcast(rows), "y_item", "left_semi")
              .withColumn("cramers_v", F.round("cramers_v", digits)))
    order = [F.col("cramers_v").desc(), F.col("x_item"), F.col("y_item")]
    return _ranked(cells, order).select(
        "id", F.col("y_item").alias("traffic_charge"), F.col("x_item").alias("drug_charge"),
        "cramers_v")


def top_items(top: DataFrame, x_group: str, y_group: str) -> DataFrame:
    """(item, grp) of the top pairs, each once."""
    both = F.array(F.struct(F.col("drug_charge").alias("item"), F.lit(x_group).alias("grp")),
                   F.struct(F.col("traffic_charge").alias("item"), F.lit(y_group).alias("grp")))
    return top.select(F.explode(both).alias("i")).select("i.*").distinct()


def pair_breakdown(df: DataFrame, top: DataFrame, basket: Sequence[str] = BOOKING,
                   item: str = "Charge", attr: str = "RaceDescription", mode: str = "either",
                   exclude: Sequence[str] | None = None) -> DataFrame:
    """For each top pair: episodes holding its items, counted by ``attr`` (C20).

    ``mode="either"`` counts episodes with either charge of the pair (the
    published breakdown), ``"both"`` those with both.  Proportions are over
    all levels; ``exclude`` then drops listed levels (NULL levels are kept).
    The pair list is k rows, so its 2k items are broadcast; one distinct and
    one aggregation replace a per-pair loop.
    """
    items = top.select("id", F.explode(F.array("traffic_charge", "drug_charge")).alias("_item"))
    hits = df.select(*basket, F.col(attr).alias("_attr"), F.col(item).alias("_item")) \
             .join(F.broadcast(items), "_item")
    if mode == "either":
        eps = hits.select("id", *basket, "_attr").distinct()
    elif mode == "both":
        eps = (hits.groupBy("id", *basket, "_attr").agg(F.count_distinct("_item").alias("_k"))
                   .join(F.broadcast(items.groupBy("id").agg(
                       F.count_distinct("_item").alias("_need"))), "id")
                   .filter(F.col("_k") == F.col("_need")).select("id", *basket, "_attr"))
    else:
        raise ValueError("mode must be 'either' or 'both'")
    counts = eps.groupBy("id", "_attr").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("id")
    counts = counts.withColumn("proportion",
                               F.col("n").cast("double") / F.sum("n").over(w).cast("double"))
    out = counts.join(F.broadcast(top), "id").select(
        "id", sentence_case(F.col("traffic_charge")).alias("traffic_charge"),
        sentence_case(F.col("drug_charge")).alias("drug_charge"), "cramers_v",
        F.col("_attr").alias("race"), F.col("n").cast("long").alias("n"), "proportion")
    if exclude:
        out = out.filter(F.col("race").isNull() | ~F.col("race").isin(list(exclude)))
    return out
