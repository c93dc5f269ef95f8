"""Fixed-width binning with interval labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_start(x: Column, lo: int = 0, hi: int = 100, width: int = 10) -> Column:
    """Left edge of the bin holding ``x``; the top edge joins the last bin."""
    start = F.floor((x - F.lit(lo)) / F.lit(width)) * F.lit(width) + F.lit(lo)
    return F.when(x.isNull() | (x < lo) | (x > hi), F.lit(None).cast("long")) \
            .otherwise(F.least(start, F.lit(hi - width)).cast("long"))


def cut_bins(x: Column, lo: int = 0, hi: int = 100, width: int = 10) -> Column:
    """Label ``[lo,hi)`` bins, the last one closed: ``[ 20, 30)`` .. ``[ 90,100]``.

    Bins are left-closed.  Numbers are padded to the width of the widest edge
    so every label has the same length; values outside ``[lo, hi]`` and NULLs
    get NULL.  ``(hi - lo)`` must be a multiple of ``width``.
    """
    if (hi - lo) % width:
        raise ValueError("hi - lo must be a multiple of width")
    pad = max(len(str(lo)), len(str(hi)))
    b = bin_start(x, lo, hi, width)
    open_fmt = f"[%{pad}d,%{pad}d)"
    closed_fmt = f"[%{pad}d,%{pad}d]"
    return F.when(b.isNull(), F.lit(None).cast("string")) \
            .when(b == F.lit(hi - width), F.format_string(closed_fmt, b, b + F.lit(width))) \
            .otherwise(F.format_string(open_fmt, b, b + F.lit(width)))


def interval_to_range_label(label: Column, sep: str = " to ") -> Column:
    """``[ 20, 25)`` -> ``20 to 24`` (C32): strip brackets and one leading
    space, split on the comma, step the upper edge down by one."""
    s = F.regexp_replace(label, r"\[|\)|\]", "")
    s = F.regexp_replace(s, "^ ", "")
    s = F.regexp_replace(s, ", ", ",")
    lo = F.substring_index(s, ",", 1)
    hi = F.substring_index(s, ",", -1).cast("int") - F.lit(1)
    return F.concat(lo, F.lit(sep), hi.cast("string"))
