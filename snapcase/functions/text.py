"""String helpers: word title case, sentence case, percent display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of letters/digits, optionally joined by '.' or an
# apostrophe between two such runs ("N.Afr" is one word); every other
# character is a token of its own.  The same pattern runs in DuckDB (RE2).
WORD_TOKEN = r"[\p{L}\p{N}]+(?:[.'][\p{L}\p{N}]+)*|[^\p{L}\p{N}]"


def title_case(s: Column) -> Column:
    """Upper-case the first character of each word, lower-case the rest."""
    tokens = F.regexp_extract_all(s, F.lit(WORD_TOKEN), 0)
    cased = F.transform(tokens, lambda t: F.concat(F.upper(F.substring(t, 1, 1)),
                                                   F.lower(F.substring(t, 2, 1 << 30))))
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(F.array_join(cased, ""))


def sentence_case(s: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def percent_text(share: Column, decimals: int = 2) -> Column:
    """Share in [0,1] as ``12.34%``, half-up on the shortest decimal form.

    The share is rounded first (``round`` works on the decimal form of the
    double, so a share of exactly 0.03125 shows as 3.13%), then printed from
    an integer so no second rounding happens.
    """
    scale = 10 ** decimals
    k = F.round(F.round(share, decimals + 2) * F.lit(100 * scale)).cast("long")
    whole = (k / F.lit(scale)).cast("long")
    if decimals == 0:
        return F.concat(whole.cast("string"), F.lit("%"))
    frac = F.lpad((k % F.lit(scale)).cast("string"), decimals, "0")
    return F.concat(whole.cast("string"), F.lit("."), frac, F.lit("%"))
