"""DuckDB oracle SQL for every registered query.

The oracles restate each operator's meaning in plain SQL over the driver's
pre-registered tables (semi-joins, scalar subqueries, QUALIFY, UNION ALL),
independent of the Spark plan, so a wrong rewrite shows up as a mismatch.
"""

from __future__ import annotations

import math

from snapcase.functions.stats import FPMIN, GAMMA_STEPS
from snapcase.functions.text import WORD_TOKEN
from snapcase.operators.profile import MONTHS
from snapcase.plans import params as P

_ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    _ORACLES[name] = sql


def oracle_sql() -> dict[str, str]:
    from snapcase.plans import oracles_ext, oracles_more  # noqa: F401
    return dict(_ORACLES)


# ---- shared fragments ---------------------------------------------------

CASE_VIEW = """
SELECT o.o_orderkey AS BookingNumber, o_orderdate AS BookingDate, l_shipdate AS SnapshotDateTime,
       CAST(p_size + 17 AS INT) AS CurrentAge,
       CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS Gender,
       c_mktsegment AS RaceDescription,
       NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS MaritalStatus,
       NULLIF(p_type, 'MEDIUM') AS ChargeGroup,
       CONCAT(p_type, ' ', p_brand) AS Charge,
       CASE l_linestatus WHEN 'F' THEN 'FELONY' ELSE 'MISDEMEANOR' END AS ChargeCategory,
       NULLIF(l_returnflag, 'N') AS ChargeDisposition
FROM lineitem JOIN orders o ON l_orderkey = o_orderkey
              JOIN customer ON o_custkey = c_custkey
              JOIN part ON l_partkey = p_partkey
"""

CASES_CTE = f"cases AS (SELECT * FROM ({CASE_VIEW}) WHERE CurrentAge <> 238)"

# Literal restatement of the episode rules: bookings with a disposition,
# the global first snapshot day over them, first disposition day per
# episode, rows strictly before it.
EPISODE_CTES = """
bn_with_disp AS (SELECT DISTINCT BookingNumber FROM cases WHERE ChargeDisposition IS NOT NULL),
sj AS (SELECT * FROM cases WHERE BookingNumber IN (SELECT BookingNumber FROM bn_with_disp)),
sj2 AS (SELECT * FROM sj
        WHERE CAST(BookingDate AS DATE) >= (SELECT min(CAST(SnapshotDateTime AS DATE)) FROM sj)),
ends AS (SELECT BookingNumber, BookingDate, min(CAST(SnapshotDateTime AS DATE)) AS end_pretrial
         FROM sj2 WHERE ChargeDisposition IS NOT NULL GROUP BY BookingNumber, BookingDate),
exposure AS (SELECT sj2.*, ends.end_pretrial FROM sj2 LEFT JOIN ends USING (BookingNumber, BookingDate)
             WHERE CAST(sj2.SnapshotDateTime AS DATE) < ends.end_pretrial)
"""

ATTRS = ["Gender", "RaceDescription", "MaritalStatus", "age_group"]
TITLED = [("Gender", "Gender"), ("Race", "RaceDescription"),
          ("Marital Status", "MaritalStatus"), ("Age", "age_group")]
RAW = [("Gender", "Gender"), ("RaceDescription", "RaceDescription"),
       ("MaritalStatus", "MaritalStatus"), ("age_group", "age_group")]


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def title_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, {q(WORD_TOKEN)}), "
            f"lambda t: upper(t[1]) || lower(t[2:])), '')")


def sentence_sql(x: str) -> str:
    return f"(upper({x}[1]) || lower({x}[2:]))"


def cut_sql(x: str, lo: int = 0, hi: int = 100, w: int = 10) -> str:
    pad = max(len(str(lo)), len(str(hi)))
    b = f"least(CAST(floor(({x} - {lo}) / {w}) AS BIGINT) * {w} + {lo}, {hi - w})"
    return (f"CASE WHEN {x} IS NULL OR {x} < {lo} OR {x} > {hi} THEN NULL "
            f"WHEN {b} = {hi - w} THEN printf('[%{pad}d,%{pad}d]', {b}, {b} + {w}) "
            f"ELSE printf('[%{pad}d,%{pad}d)', {b}, {b} + {w}) END")


def first_sql(src: str, keys: list[str], order: list[str], carry: list[str]) -> str:
    cols = order + [c for c in carry if c not in order]
    ob = ", ".join(f"{c} ASC NULLS FIRST" for c in cols)
    return (f"SELECT {', '.join(keys + cols)} FROM {src} "
            f"QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {ob}) = 1")


def counts_sql(src: str, groups, by: list[str] = (), title: bool = True,
               missing: str | None = "Missing") -> str:
    pre = "".join(f"{b}, " for b in by)
    parts = [f"SELECT {pre}{q(g)} AS groupname, CAST({c} AS VARCHAR) AS rowname FROM {src}"
             for g, c in groups]
    label = "rowname"
    if title:
        label = title_sql(label)
    if missing is not None:
        label = f"coalesce({label}, {q(missing)})"
    return (f"SELECT {pre}groupname, {label} AS rowname, count(*) AS n "
            f"FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL")


def shares_sql(src: str, by: list[str]) -> str:
    part = ", ".join(list(by) + ["groupname"])
    return (f"SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY {part}) AS DOUBLE) "
            f"AS share, sum(n) OVER (PARTITION BY {part}) AS denom FROM {src}")


def pivot_sql(src: str, rows: list[str], key: str, value: str, cols: list[str],
              fill: str | None = None, agg: str = "max") -> str:
    items = []
    for c in cols:
        e = f"{agg}({value}) FILTER (WHERE {key} = {q(c)})"
        if fill is not None:
            e = f"coalesce({e}, {fill})"
        items.append(f"{e} AS \"{c}\"")
    return f"SELECT {', '.join(rows)}, {', '.join(items)} FROM {src} GROUP BY {', '.join(rows)}"


def suffix_sql(col: str, categories=P.CATEGORIES) -> str:
    whens = " ".join(f"WHEN {q(c)} THEN {q(s)}" for c, s in categories)
    return f"CASE {col} {whens} END"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def periods_cte(periods=P.PERIODS) -> str:
    rows = ", ".join(f"({q(n)}, DATE '{s}', DATE '{e}')" for n, s, e in periods)
    return f"periods(name, p_start, p_end) AS (VALUES {rows})"


def gamma_q_half_sql(z: str) -> str:
    """Q(1/2, z) with the same folds as :func:`snapcase.functions.stats.gamma_q_half`."""
    z = f"({z})"
    pre = f"(sqrt({z}) * exp(-{z}) / {math.sqrt(math.pi)!r})"
    steps = f"range(1, {GAMMA_STEPS + 1})"
    series = (f"list_reduce({steps}, lambda acc, i: struct_pack(ap := acc.ap + 1.0, "
              f"de := acc.de * {z} / (acc.ap + 1.0), s := acc.s + acc.de * {z} / (acc.ap + 1.0)), "
              "struct_pack(ap := CAST(0.5 AS DOUBLE), de := CAST(2.0 AS DOUBLE), "
              "s := CAST(2.0 AS DOUBLE))).s")
    an = "(-(i * (i - 0.5)))"
    b2 = "(acc.b + 2.0)"

    def guard(x):
        return f"(CASE WHEN abs({x}) < {FPMIN!r} THEN CAST({FPMIN!r} AS DOUBLE) ELSE {x} END)"
    d = guard(f"({an} * acc.d + {b2})")
    c = guard(f"({b2} + {an} / acc.c)")
    b0 = f"CAST({z} + 0.5 AS DOUBLE)"
    cf = (f"list_reduce({steps}, lambda acc, i: struct_pack(b := {b2}, c := {c}, "
          f"d := 1.0 / {d}, h := acc.h * (1.0 / {d}) * {c}), "
          f"struct_pack(b := {b0}, c := CAST({1.0 / FPMIN!r} AS DOUBLE), d := 1.0 / {b0}, "
          f"h := 1.0 / {b0})).h")
    return f"(CASE WHEN {z} < 1.5 THEN 1.0 - {series} * {pre} ELSE {pre} * {cf} END)"


# ---- scans and episodes -------------------------------------------------

oracle("snapshot_scan", with_ctes(CASES_CTE, body="SELECT * FROM cases"))

oracle("pretrial_rowlevel", with_ctes(CASES_CTE, body=f"""
SELECT * FROM cases WHERE ChargeDisposition IS NULL AND year(SnapshotDateTime) = {P.YEAR}"""))

oracle("episode_end", with_ctes(CASES_CTE, EPISODE_CTES, body="SELECT * FROM ends"))

oracle("pretrial_exposure", with_ctes(CASES_CTE, EPISODE_CTES, body="""
SELECT BookingNumber, BookingDate, SnapshotDateTime, Charge, ChargeCategory, ChargeDisposition,
       end_pretrial FROM exposure"""))

_EX_AGE = f"ex AS (SELECT *, {cut_sql('CurrentAge')} AS age_group FROM exposure)"

oracle("first_obs_per_episode", with_ctes(CASES_CTE, EPISODE_CTES, _EX_AGE, body=first_sql(
    "ex", ["BookingNumber", "BookingDate"], ["SnapshotDateTime"], ATTRS)))

oracle("cut_bins", with_ctes(CASES_CTE, body=f"""
SELECT {cut_sql('CurrentAge', 0, 100, 10)} AS age_group_10,
       {cut_sql('CurrentAge', 0, 100, 5)} AS age_group_5, count(*) AS n
FROM cases GROUP BY ALL"""))

# ---- profile tables -----------------------------------------------------

oracle("profile_counts", with_ctes(
    CASES_CTE, EPISODE_CTES, _EX_AGE,
    "first_rows AS (" + first_sql("ex", ["BookingNumber", "BookingDate"],
                                  ["SnapshotDateTime"], ATTRS) + ")",
    body=counts_sql("first_rows", TITLED)))

_MONTH_TOTALS = ", ".join(f"CAST(coalesce(sum({m}), 0) AS BIGINT) AS {m}" for m in MONTHS)
oracle("profile_monthly_counts", with_ctes(
    CASES_CTE,
    f"""rows_y AS (SELECT *, {cut_sql('CurrentAge')} AS age_group FROM cases
        WHERE ChargeDisposition IS NULL AND year(SnapshotDateTime) = {P.YEAR}
          AND ChargeCategory = 'MISDEMEANOR')""",
    "first_rows AS (" + first_sql("rows_y", ["BookingNumber", "BookingDate"],
                                  ["SnapshotDateTime"], ATTRS) + ")",
    "m AS (SELECT *, monthname(SnapshotDateTime) AS month FROM first_rows)",
    "counts AS (" + counts_sql("m", RAW, by=["month"], title=False, missing=None) + ")",
    "wide AS (" + pivot_sql("counts", ["groupname", "rowname"], "month", "n", list(MONTHS)) + ")",
    body=f"""SELECT groupname, rowname, false AS is_total, {', '.join(MONTHS)} FROM wide
UNION ALL
SELECT groupname, 'Total' AS rowname, true AS is_total, {_MONTH_TOTALS} FROM wide GROUP BY groupname"""))

_CAT_LIST = in_list([c for c, _ in P.CATEGORIES])
oracle("profile_monthly_shares", with_ctes(
    CASES_CTE, EPISODE_CTES,
    f"""ex AS (SELECT *, {cut_sql('CurrentAge')} AS age_group FROM exposure
        WHERE year(SnapshotDateTime) = {P.YEAR} AND ChargeCategory IN {_CAT_LIST})""",
    "first_rows AS (" + first_sql("ex", ["BookingNumber", "BookingDate", "ChargeCategory"],
                                  ["SnapshotDateTime"], ATTRS) + ")",
    f"m AS (SELECT *, monthname(SnapshotDateTime) || '_' || {suffix_sql('ChargeCategory')} AS col "
    "FROM first_rows)",
    "counts AS (" + counts_sql("m", TITLED, by=["col"]) + ")",
    "shares AS (" + shares_sql("counts", ["col"]) + ")",
    body=pivot_sql("shares", ["groupname", "rowname"], "col", "share",
                   [f"{m}_{s}" for _, s in P.CATEGORIES for m in MONTHS], fill="0.0")))

_PERIOD_COLS = [f"n_{p[0]}_{s}" for p in P.PERIODS for _, s in P.CATEGORIES]
_PERIOD_CTES = (
    CASES_CTE, EPISODE_CTES, periods_cte(),
    f"""ex AS (SELECT e.*, p.name AS period, {cut_sql('e.CurrentAge')} AS age_group
        FROM exposure e JOIN periods p
          ON CAST(e.SnapshotDateTime AS DATE) BETWEEN p.p_start AND p.p_end
        WHERE e.ChargeCategory IN {_CAT_LIST})""",
    "first_rows AS (" + first_sql("ex", ["BookingNumber", "BookingDate", "period",
                                         "ChargeCategory"], ["SnapshotDateTime"], ATTRS) + ")",
    f"m AS (SELECT *, 'n_' || period || '_' || {suffix_sql('ChargeCategory')} AS col "
    "FROM first_rows)",
    "counts AS (" + counts_sql("m", TITLED, by=["col"]) + ")",
    "shares AS (" + shares_sql("counts", ["col"]) + ")",
)
oracle("profile_period_shares", with_ctes(*_PERIOD_CTES, body=pivot_sql(
    "shares", ["groupname", "rowname"], "col", "share", _PERIOD_COLS, fill="0.0")))


def _pct_sql(n: str, d: str, decimals: int = 2) -> str:
    """Exact half-up percent text from integer numerator / denominator."""
    scale = 10 ** (decimals + 2)
    k = f"((2 * {scale} * CAST({n} AS HUGEINT) + {d}) // (2 * {d}))"
    div = 10 ** decimals
    return (f"(CAST({k} // {div} AS VARCHAR) || '.' || "
            f"lpad(CAST({k} % {div} AS VARCHAR), {decimals}, '0') || '%')")


_disp = []
for _p in P.PERIODS:
    _parts = []
    for _, _s in P.CATEGORIES:
        _c = f"n_{_p[0]}_{_s}"
        _parts.append(f"coalesce(max({_pct_sql('n', 'denom')}) FILTER (WHERE col = {q(_c)}), "
                      f"'0.00%')")
    _disp.append(f"{_parts[0]} || '<br>(' || {_parts[1]} || ')' AS fy_{_p[0]}")
oracle("share_display", with_ctes(*_PERIOD_CTES, body=(
    f"SELECT groupname, rowname, {', '.join(_disp)} FROM shares GROUP BY groupname, rowname")))
