"""Category recoding: ordered override rules (C02) and short names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules_map(rules: Iterable[tuple[str, str]]) -> Column | None:
    """Literal map value -> category, the last rule for a value winning."""
    last: dict[str, str] = {}
    for value, category in rules:
        last.pop(value, None)
        last[value] = category
    if not last:
        return None
    return F.create_map(*[F.lit(x) for kv in last.items() for x in kv])


def recode_group(df: DataFrame, rules, key: str = "Charge", target: str = "ChargeGroup",
                 null_key_wipes: bool = True) -> DataFrame:
    """Override ``target`` where ``key`` matches a rule.

    ``rules`` is an ordered list of ``(key value, category)`` -- the last
    rule for a value wins -- or a DataFrame ``(value, category, ordinal)``
    for rule sets too large to inline.  With ``null_key_wipes`` a NULL key
    sets the target to NULL, as an ``ifelse`` chain on a missing key does.

    A list becomes one map lookup per row inside the generated code (no
    join); a DataFrame is reduced to one category per value and left-joined
    on the key, with Spark's size-checked broadcast choosing the strategy.
    """
    k = F.col(key)
    if isinstance(rules, DataFrame):
        last = rules.groupBy("value").agg(F.max_by("category", "ordinal").alias("_recode"))
        joined = df.join(last, k == last["value"], "left").drop("value")
        hit = F.col("_recode")
        has_rules = True
    else:
        m = rules_map(rules)
        has_rules = m is not None
        joined = df
        hit = m[k] if has_rules else F.lit(None).cast("string")
    if not has_rules:
        return df
    new = F.coalesce(hit, F.col(target))
    if null_key_wipes:
        new = F.when(k.isNull(), F.lit(None).cast("string")).otherwise(new)
    out = joined.withColumn(target, new)
    return out.drop("_recode") if isinstance(rules, DataFrame) else out


def short_names(df: DataFrame, dim, col: str = "ChargeGroup",
                out: str = "ChargeGroupShort", dim_key: str = "ChargeGroup",
                dim_value: str = "ChargeGroupShort") -> DataFrame:
    """Attach the short display name of a category, falling back to the
    long name (C03).

    ``dim`` as a list of (long, short) pairs becomes a literal map lookup in
    the generated code -- no join, so no shuffle on a low-cardinality key
    where one category may hold a third of the rows.  A DataFrame ``dim`` is
    left-joined; Spark broadcasts it when its measured size allows.
    """
    if not isinstance(dim, DataFrame):
        m = rules_map(dim)
        short = m[F.col(col)] if m is not None else F.lit(None).cast("string")
        return df.withColumn(out, F.coalesce(short, F.col(col)))
    d = dim.select(F.col(dim_key).alias("_k"), F.col(dim_value).alias("_short"))
    return (df.join(d, F.col(col) == F.col("_k"), "left")
              .withColumn(out, F.coalesce(F.col("_short"), F.col(col)))
              .drop("_k", "_short"))


def recode_values(col: Column, mapping: dict[str, str]) -> Column:
    """``recode``: replace listed values, leave the others unchanged."""
    if not mapping:
        return col
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[col], col)
