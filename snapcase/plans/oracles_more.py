"""Oracle SQL for the recode, contingency, association, population and
extension queries (registered into :mod:`snapcase.plans.oracles`)."""

from __future__ import annotations

from snapcase.functions.stats import CHISQ1_95, Z_975
from snapcase.plans import params as P
from snapcase.plans.oracles import (CASES_CTE, gamma_q_half_sql, in_list, oracle, pivot_sql, q,
                                    sentence_sql, with_ctes)
from snapcase.sources.dimensions import CATEGORY_SHORT_NAMES

DIGITS = 8


def rnd(x: str, digits: int = DIGITS) -> str:
    return f"round({x}, {digits})"


# ---- recoding -----------------------------------------------------------

def _recode_case() -> str:
    last: dict[str, str] = {}
    for v, c in P.RECODE_RULES:
        last[v] = c
    whens = " ".join(f"WHEN Charge = {q(v)} THEN {q(c)}" for v, c in last.items())
    return f"CASE WHEN Charge IS NULL THEN NULL {whens} ELSE ChargeGroup END"


oracle("recode_group", with_ctes(CASES_CTE, body=f"""
SELECT Charge, {_recode_case()} AS ChargeGroup, count(*) AS n FROM cases GROUP BY ALL"""))

_DIM_ROWS = ", ".join(f"({q(a)}, {q(b)})" for a, b in list(CATEGORY_SHORT_NAMES) + list(P.SHORT_NAMES))
oracle("group_short_name", with_ctes(
    CASES_CTE, f"dim(k, s) AS (VALUES {_DIM_ROWS})",
    body="""SELECT ChargeGroup, coalesce(s, ChargeGroup) AS ChargeGroupShort, count(*) AS n
FROM cases LEFT JOIN dim ON ChargeGroup = k GROUP BY ALL"""))

# ---- flags and contingency ---------------------------------------------

_RACES = in_list([P.RACE_A, P.RACE_B])


def flags_ctes(strata: str | None = None):
    """Flag CTEs; ``strata`` is an SQL expression named ``stratum``."""
    st_sel = f"{strata} AS stratum, " if strata else ""
    st_col = "stratum, " if strata else ""
    return (
        CASES_CTE,
        f"""rescued AS (SELECT *, {st_sel}CASE WHEN ChargeGroup IS NULL AND contains(Charge, {q(P.RESCUE_PATTERN)})
                      THEN {q(P.DRUG_GROUP)} ELSE ChargeGroup END AS g0 FROM cases)""",
        f"""grouped AS (SELECT BookingNumber, BookingDate, {st_col}RaceDescription AS race,
          CASE WHEN g0 IN ({q(P.DRUG_GROUP)}, {q(P.TRAFFIC_GROUP)}) THEN g0
               WHEN g0 IS NOT NULL THEN 'Other' END AS g
        FROM rescued WHERE RaceDescription IN {_RACES})""",
        f"""flags AS (SELECT BookingNumber, BookingDate, {st_col}race,
          CASE WHEN bool_or(g = {q(P.DRUG_GROUP)}) THEN 'Yes' ELSE 'No' END AS drugs,
          CASE WHEN bool_or(g = {q(P.TRAFFIC_GROUP)}) THEN 'Yes' ELSE 'No' END AS traffic,
          CASE WHEN bool_or(g = 'Other') THEN 'Yes' ELSE 'No' END AS other
        FROM grouped WHERE g IS NOT NULL GROUP BY BookingNumber, BookingDate, {st_col}race)""",
    )


FLAGS_CTES = flags_ctes()

oracle("episode_flags", with_ctes(*FLAGS_CTES, body="SELECT * FROM flags"))

oracle("freq_table", with_ctes(*FLAGS_CTES, body="""
SELECT race, traffic, drugs, other, count(*) AS freq FROM flags GROUP BY ALL"""))

_GRID = f"""grid AS (SELECT * FROM (VALUES ({q(P.RACE_A)}, 0), ({q(P.RACE_B)}, 1)) r(race, ri)
   CROSS JOIN (VALUES ('Yes', 0), ('No', 1)) o(drugs, oi)
   CROSS JOIN (VALUES ('No', 0), ('Yes', 1)) g(traffic, gi))"""
_XTAB = ("xt AS (SELECT race, drugs, traffic, CAST(coalesce(cnt, 0) AS BIGINT) AS freq, "
         "ri * 4 + oi * 2 + gi AS cell_order FROM grid LEFT JOIN "
         "(SELECT race, drugs, traffic, count(*) AS cnt FROM flags GROUP BY ALL) "
         "USING (race, drugs, traffic))")

oracle("xtab3", with_ctes(*FLAGS_CTES, _GRID, _XTAB, body="SELECT * FROM xt"))

oracle("flat_table", with_ctes(*FLAGS_CTES, _GRID, _XTAB, body="""
SELECT race, drugs,
       CAST(sum(freq) FILTER (WHERE traffic = 'No') AS BIGINT) AS traffic_no,
       CAST(sum(freq) FILTER (WHERE traffic = 'Yes') AS BIGINT) AS traffic_yes
FROM xt GROUP BY race, drugs"""))

# Eight cells c_<race>_<drugs>_<traffic>, 0 = No / first race.
_CELLS = [(r, d, t) for r in (0, 1) for d in (0, 1) for t in (0, 1)]


def _c(r, d, t) -> str:
    return f"c_{r}_{d}_{t}"


_RACE_NAMES = (P.RACE_A, P.RACE_B)
_YN = ("No", "Yes")
def cells_cte(strata: bool = False) -> str:
    sel = "stratum, " if strata else ""
    grp = " GROUP BY stratum" if strata else ""
    return "cells AS (SELECT " + sel + ", ".join(
        f"count(*) FILTER (WHERE race = {q(_RACE_NAMES[r])} AND drugs = {q(_YN[d])} "
        f"AND traffic = {q(_YN[t])}) AS {_c(r, d, t)}" for r, d, t in _CELLS) + f" FROM flags{grp})"


_CELLS_CTE = cells_cte()


def _n(r, d, t) -> str:
    return f"CAST({_c(r, d, t)} AS DOUBLE)"


def _sum(xs) -> str:
    out = xs[0]
    for x in xs[1:]:
        out = f"({out} + {x})"
    return out


def _margins():
    n = {k: _n(*k) for k in _CELLS}
    N = _sum([n[k] for k in _CELLS])
    dt = {(d, t): f"({n[(0, d, t)]} + {n[(1, d, t)]})" for d in (0, 1) for t in (0, 1)}
    rd = {(r, d): f"({n[(r, d, 0)]} + {n[(r, d, 1)]})" for r in (0, 1) for d in (0, 1)}
    rt = {(r, t): f"({n[(r, 0, t)]} + {n[(r, 1, t)]})" for r in (0, 1) for t in (0, 1)}
    r1 = {r: f"({rd[(r, 0)]} + {rd[(r, 1)]})" for r in (0, 1)}
    d1 = {d: f"({dt[(d, 0)]} + {dt[(d, 1)]})" for d in (0, 1)}
    t1 = {t: f"({dt[(0, t)]} + {dt[(1, t)]})" for t in (0, 1)}
    return n, N, dt, rd, rt, r1, d1, t1


def _idx(r, d, t):
    return r * 4 + d * 2 + t + 1   # DuckDB lists are 1-based


def _ipf_ctes(dt, rd, rt) -> tuple[str, str]:
    """Proportional fitting in cycles of three margins until no cell moves."""
    def fit(m, target, key_of):
        out = []
        for c in _CELLS:
            partners = [p for p in _CELLS if key_of(*p) == key_of(*c)]
            fitted = _sum([f"{m}[{_idx(*p)}]" for p in partners])
            out.append(f"CASE WHEN {fitted} = 0 THEN 0.0 ELSE {m}[{_idx(*c)}] * {target[key_of(*c)]} "
                       f"/ {fitted} END")
        return "CAST([" + ", ".join(out) + "] AS DOUBLE[])"
    start = "[" + ", ".join("CAST(1.0 AS DOUBLE)" for _ in _CELLS) + "]"
    moved = ", ".join(f"CASE WHEN m3[{i}] = 0 THEN 0.0 ELSE abs(m3[{i}] - m[{i}]) / m3[{i}] END"
                      for i in range(1, 9))
    cells = ", ".join(_c(*k) for k in _CELLS)
    ipf = f"""ipf AS (
    SELECT {{stratum}}{cells}, {start} AS m, CAST(1 AS DOUBLE) AS moved, 0 AS cycle FROM cells
    UNION ALL
    SELECT {{stratum}}{cells}, m3, CAST(greatest({moved}) AS DOUBLE), cycle + 1 FROM (
      SELECT *, {fit('m2', rt, lambda r, d, t: (r, t))} AS m3 FROM (
        SELECT *, {fit('m1', rd, lambda r, d, t: (r, d))} AS m2 FROM (
          SELECT *, {fit('m', dt, lambda r, d, t: (d, t))} AS m1 FROM ipf
          WHERE moved > 4e-15 AND cycle < 20000))))"""
    return ipf, """fitted AS (SELECT *, m AS homog FROM ipf
    QUALIFY row_number() OVER ({partition} ORDER BY cycle DESC) = 1)"""


def _unit_sql(p: str) -> str:
    return f"(CASE WHEN {p} > 1.0 THEN CAST(1.0 AS DOUBLE) ELSE {p} END)"


def _p_sql(x: str, df: int) -> str:
    half = f"(({x}) / 2.0)"
    if df == 0:
        return "CAST(1.0 AS DOUBLE)"
    if df == 1:
        return _unit_sql(gamma_q_half_sql(half))
    if df == 2:
        return f"exp(-{half})"
    if df == 3:
        return _unit_sql(f"({gamma_q_half_sql(half)} + sqrt(2.0 * ({x}) / pi()) * exp(-{half}))")
    return f"(exp(-{half}) * (1.0 + {half}))"


def _loglinear_sql(strata: str | None = None) -> str:
    n, N, dt, rd, rt, r1, d1, t1 = _margins()
    closed = {
        "independence": [f"{r1[r]} * {d1[d]} * {t1[t]} / ({N} * {N})" for r, d, t in _CELLS],
        "joint_dt_r": [f"{dt[(d, t)]} * {r1[r]} / {N}" for r, d, t in _CELLS],
        "conditional_dt_dr": [f"{dt[(d, t)]} * {rd[(r, d)]} / {d1[d]}" for r, d, t in _CELLS],
        "conditional_dt_tr": [f"{dt[(d, t)]} * {rt[(r, t)]} / {t1[t]}" for r, d, t in _CELLS],
        "homogeneous": [f"homog[{_idx(*k)}]" for k in _CELLS],
        "saturated": [n[k] for k in _CELLS],
    }
    models = (("independence", 4), ("joint_dt_r", 3), ("conditional_dt_dr", 2),
              ("conditional_dt_tr", 2), ("homogeneous", 1), ("saturated", 0))
    selects = []
    for name, df in models:
        fit = [f"CASE WHEN {n[k]} = 0 THEN coalesce({f}, 0.0) ELSE {f} END"
               for k, f in zip(_CELLS, closed[name])]
        g2 = "greatest(0.0, " + _sum([f"(CASE WHEN {n[k]} > 0 THEN {n[k]} * ln({n[k]} / ({fit[i]})) ELSE 0.0 END)"
                         for i, k in enumerate(_CELLS)]) + " * 2.0)"
        x2 = _sum([f"coalesce(({n[k]} - ({fit[i]})) * ({n[k]} - ({fit[i]})) / nullif({fit[i]}, 0), 0.0)"
                   for i, k in enumerate(_CELLS)])
        selects.append(
            f"SELECT {'stratum AS booking_year, ' if strata else ''}{q(name)} AS model, {df} AS df, "
            f"{rnd(g2)} AS g2, {rnd(x2)} AS x2, "
            f"{rnd(_p_sql(g2, df))} AS p_g2, {rnd(_p_sql(x2, df))} AS p_x2 FROM fitted")
    ipf, fitted = _ipf_ctes(dt, rd, rt)
    sql = with_ctes(*flags_ctes(strata), cells_cte(bool(strata)),
                    ipf.format(stratum="stratum, " if strata else ""),
                    fitted.format(partition="PARTITION BY stratum" if strata else ""),
                    body="\nUNION ALL\n".join(selects))
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


oracle("loglinear_fit", _loglinear_sql())


def _odds_sql(strata: bool = False):
    names = [_c(*k) for k in _CELLS]
    any_zero = " OR ".join(f"{c} = 0" for c in names)
    adj = f"(CASE WHEN {any_zero} THEN 0.5 ELSE 0.0 END)"
    parts = []
    for outcome in ("drugs", "traffic"):
        given = "traffic" if outcome == "drugs" else "drugs"
        for gi, gv in enumerate(_YN):
            def n(r, o_yes):
                d, t = ((o_yes, gi) if outcome == "drugs" else (gi, o_yes))
                return f"(CAST({_c(r, d, t)} AS DOUBLE) + {adj})"
            a, b, c, d_ = n(0, 1), n(0, 0), n(1, 1), n(1, 0)
            log_or = f"(ln({a}) + ln({d_}) - ln({b}) - ln({c}))"
            se = f"sqrt(1.0 / {a} + 1.0 / {b} + 1.0 / {c} + 1.0 / {d_})"
            parts.append(
                f"SELECT {'stratum AS booking_year, ' if strata else ''}"
                f"'{outcome}|{given}' AS orientation, {q(gv)} AS given_level, "
                f"({a} * {d_}) / ({b} * {c}) AS odds_ratio, {log_or} AS log_or, {se} AS ase, "
                f"exp({log_or} - {Z_975!r} * {se}) AS lwr, exp({log_or} + {Z_975!r} * {se}) AS upr "
                "FROM cells")
    return "\nUNION ALL\n".join(parts)


_ODDS_CTE = f"odds AS ({_odds_sql()})"
oracle("conditional_odds_ratio", with_ctes(*FLAGS_CTES, _CELLS_CTE, _ODDS_CTE, body="""
SELECT orientation, given_level, odds_ratio FROM odds"""))
oracle("odds_ratio_ci", with_ctes(*FLAGS_CTES, _CELLS_CTE, _ODDS_CTE, body=f"""
SELECT orientation, given_level, {rnd('log_or')} AS log_or, {rnd('ase')} AS ase,
       {rnd('lwr')} AS lwr, {rnd('upr')} AS upr, (lwr <= 1.0 AND upr >= 1.0) AS contains_one
FROM odds"""))

# ---- association --------------------------------------------------------

_X, _Y = q(P.DRUG_GROUP), q(P.TRAFFIC_GROUP)
PAIR_CTES = (
    CASES_CTE,
    f"""bi AS (SELECT DISTINCT BookingNumber, BookingDate, Charge, ChargeGroup FROM cases
        WHERE ChargeGroup IN ({_X}, {_Y}) AND Charge IS NOT NULL)""",
    "nb AS (SELECT count(*) AS n FROM (SELECT DISTINCT BookingNumber, BookingDate FROM bi))",
    f"mx AS (SELECT Charge AS x_item, count(*) AS mx FROM bi WHERE ChargeGroup = {_X} GROUP BY 1)",
    f"my AS (SELECT Charge AS y_item, count(*) AS my FROM bi WHERE ChargeGroup = {_Y} GROUP BY 1)",
    f"""co AS (SELECT a.Charge AS x_item, b.Charge AS y_item, count(*) AS n11
        FROM bi a JOIN bi b ON a.BookingNumber = b.BookingNumber AND a.BookingDate = b.BookingDate
        WHERE a.ChargeGroup = {_X} AND b.ChargeGroup = {_Y} GROUP BY 1, 2)""",
    """pairs AS (SELECT x_item, y_item, coalesce(n11, 0) AS n11,
          mx - coalesce(n11, 0) AS n10, my - coalesce(n11, 0) AS n01,
          n - mx - my + coalesce(n11, 0) AS n00, n
        FROM mx CROSS JOIN my CROSS JOIN nb LEFT JOIN co USING (x_item, y_item))""",
)


def _chi2_sql() -> str:
    nd, mxd, myd, n11d = ("CAST(n AS DOUBLE)", "CAST(n11 + n10 AS DOUBLE)",
                          "CAST(n11 + n01 AS DOUBLE)", "CAST(n11 AS DOUBLE)")
    d = f"(abs({nd} * {n11d} - {mxd} * {myd}) / {nd})"
    corr = f"({d} - least({d}, 0.5))"
    inv_e = f"(({nd} * {nd} * {nd}) / ({mxd} * ({nd} - {mxd}) * {myd} * ({nd} - {myd})))"
    ok = f"({mxd} > 0 AND {mxd} < {nd} AND {myd} > 0 AND {myd} < {nd})"
    return f"CASE WHEN {ok} THEN {corr} * {corr} * {inv_e} END"


V_CTES = PAIR_CTES + (
    f"chi AS (SELECT *, {_chi2_sql()} AS chi2 FROM pairs)",
    f"""v AS (SELECT *, {_unit_sql(gamma_q_half_sql('chi2 / 2.0'))} AS p_value,
        CASE WHEN chi2 > {CHISQ1_95!r} THEN sqrt(chi2 / CAST(n AS DOUBLE)) END AS cramers_v FROM chi)""",
)

_ITEMS = list(P.DRUG_ITEMS) + list(P.TRAFFIC_ITEMS)
_IND_COLS = ", ".join(f"CAST(max(CASE WHEN Charge = {q(i)} THEN 1 ELSE 0 END) AS BIGINT) AS \"{i}\""
                      for i in _ITEMS)
oracle("indicator_matrix", with_ctes(*PAIR_CTES[:2], body=f"""
SELECT BookingNumber, BookingDate, {_IND_COLS} FROM bi GROUP BY BookingNumber, BookingDate"""))

oracle("item_pair_contingency", with_ctes(*PAIR_CTES, body="SELECT * FROM pairs"))
oracle("chisq_yates", with_ctes(*V_CTES, body=f"""
SELECT x_item, y_item, chi2, {rnd('p_value')} AS p_value FROM v"""))
oracle("cramers_v", with_ctes(*V_CTES, body="SELECT x_item, y_item, cramers_v FROM v"))
oracle("assoc_matrix", with_ctes(*V_CTES, body=pivot_sql(
    "v", ["y_item"], "x_item", "cramers_v", list(P.DRUG_ITEMS), agg="first")))

_TOP = (f"top AS (SELECT row_number() OVER (ORDER BY cramers_v DESC, x_item, y_item) AS id, "
        f"y_item AS traffic_charge, x_item AS drug_charge, cramers_v FROM v "
        f"WHERE cramers_v IS NOT NULL ORDER BY cramers_v DESC, x_item, y_item LIMIT {P.TOP_K})")
oracle("assoc_topk", with_ctes(*V_CTES, _TOP, body="SELECT * FROM top"))
oracle("assoc_topk_cross", with_ctes(*V_CTES, _TOP, body="""
SELECT row_number() OVER (ORDER BY round(cramers_v, 5) DESC, x_item, y_item) AS id,
       y_item AS traffic_charge, x_item AS drug_charge, round(cramers_v, 5) AS cramers_v
FROM v WHERE cramers_v IS NOT NULL
  AND x_item IN (SELECT drug_charge FROM top) AND y_item IN (SELECT traffic_charge FROM top)"""))

oracle("pair_breakdown", with_ctes(*V_CTES, _TOP, body=f"""
SELECT id, {sentence_sql('traffic_charge')} AS traffic_charge, {sentence_sql('drug_charge')} AS drug_charge,
       cramers_v, race, n, proportion
FROM (
  SELECT t.id, t.traffic_charge, t.drug_charge, t.cramers_v, e.race, count(*) AS n,
         CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY t.id) AS DOUBLE) AS proportion
  FROM top t JOIN (SELECT DISTINCT c.BookingNumber, c.BookingDate, c.RaceDescription AS race, t2.id
                   FROM cases c JOIN top t2 ON c.Charge IN (t2.traffic_charge, t2.drug_charge)) e
    ON t.id = e.id
  GROUP BY t.id, t.traffic_charge, t.drug_charge, t.cramers_v, e.race)
WHERE race IS NULL OR race NOT IN {in_list(P.EXCLUDED_RACES)}"""))


# ---- population comparison ---------------------------------------------

from snapcase.operators.population import DROP_AGES, DROP_RACES  # noqa: E402
from snapcase.plans.oracles import first_sql, cut_sql  # noqa: E402
from snapcase.sources.population import ASIAN, PACIFIC, SEGMENT_RACE  # noqa: E402

_SEG = " ".join(f"WHEN c_mktsegment = {q(s)} THEN {q(r)}" for s, r in SEGMENT_RACE)
_AGE = "(18 + c_custkey % 50)"
_LO = f"CAST(floor({_AGE} / 5) * 5 AS INT)"
POP_CTES = (
    f"""cust AS (SELECT
      CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN
             CASE WHEN c_custkey % 3 = 0 THEN {q(PACIFIC)} ELSE {q(ASIAN)} END
           {_SEG} END AS RACE,
      'Age ' || CAST({_LO} AS VARCHAR) || ' to ' || CAST({_LO} + 4 AS VARCHAR) || ' years' AS AGEGROUP,
      CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS SEX,
      CASE WHEN c_nationkey % 4 = 0 THEN 'Hispanic' ELSE 'Non-Hispanic' END AS HISP
    FROM customer)""",
    """pop AS (SELECT
      CASE WHEN grouping(RACE) = 1 THEN 'All races' ELSE RACE END AS RACE,
      CASE WHEN grouping(AGEGROUP) = 1 THEN 'All ages' ELSE AGEGROUP END AS AGEGROUP,
      CASE WHEN grouping(SEX) = 1 THEN 'Both sexes' ELSE SEX END AS SEX,
      CASE WHEN grouping(HISP) = 1 THEN 'Both Hispanic Origins' ELSE HISP END AS HISP,
      count(*) AS value
    FROM cust GROUP BY GROUPING SETS ((RACE, AGEGROUP, SEX, HISP), (AGEGROUP, SEX, HISP),
      (RACE, SEX, HISP), (RACE, AGEGROUP, HISP), (RACE, AGEGROUP, SEX)))""",
)
_DETAIL_WHERE = (f"(AGEGROUP IS NULL OR AGEGROUP NOT IN {in_list(DROP_AGES)}) "
                 f"AND (RACE IS NULL OR RACE NOT IN {in_list(DROP_RACES)}) AND SEX <> 'Both sexes'")
_RECODE = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in P.POP_RACE_RECODE.items())
DETAIL_CTE = (f"""detail AS (SELECT CASE RACE {_RECODE} ELSE RACE END AS Race, AGEGROUP AS Age,
      SEX AS Gender, value AS ref_count FROM pop WHERE HISP = 'Non-Hispanic' AND {_DETAIL_WHERE})""")
_MEMBERS = in_list(P.POP_MERGE[0])
MERGED_CTE = f"""merged AS (
    SELECT Race, Age, Gender, ref_count FROM detail WHERE Race IS NULL OR Race NOT IN {_MEMBERS}
    UNION ALL
    SELECT {q(P.POP_MERGE[1])} AS Race, Age, Gender, CAST(sum(ref_count) AS BIGINT) AS ref_count
    FROM detail WHERE Race IN {_MEMBERS} GROUP BY Age, Gender)"""
REF_CTE = f"""reference AS (
    SELECT Race, regexp_replace(Age, 'Age | years', '', 'g') AS Age, Gender, ref_count FROM (
      SELECT * FROM merged
      UNION ALL
      SELECT {q(P.POP_ORIGIN_LABEL)} AS Race, AGEGROUP AS Age, SEX AS Gender,
             CAST(sum(value) AS BIGINT) AS ref_count
      FROM pop WHERE HISP = 'Hispanic' AND {_DETAIL_WHERE} GROUP BY AGEGROUP, SEX))"""

oracle("population_filter", with_ctes(*POP_CTES, DETAIL_CTE, body="SELECT * FROM detail"))
oracle("merge_categories", with_ctes(*POP_CTES, DETAIL_CTE, MERGED_CTE, body="SELECT * FROM merged"))
oracle("marginal_category", with_ctes(*POP_CTES, DETAIL_CTE, MERGED_CTE, REF_CTE,
                                      body="SELECT * FROM reference"))

CASE_SIDE_CTES = (
    CASES_CTE,
    f"""rows_y AS (SELECT *, {cut_sql('CurrentAge', 0, 100, 5)} AS age_band FROM cases
        WHERE ChargeDisposition IS NULL AND year(SnapshotDateTime) = {P.YEAR}
          AND (RaceDescription IS NULL OR RaceDescription NOT IN {in_list(P.CASE_EXCLUDED)}))""",
    "first_rows AS (" + first_sql("rows_y", ["BookingNumber", "BookingDate"], ["SnapshotDateTime"],
                                  ["RaceDescription", "Gender", "age_band"]) + ")",
    """obs AS (SELECT RaceDescription AS Race, Gender, age_band AS Age, count(*) AS n
        FROM first_rows GROUP BY ALL)""",
    """complete AS (SELECT g.Race, g.Gender, g.Age, CAST(coalesce(o.n, 0) AS BIGINT) AS n
        FROM (SELECT * FROM (SELECT DISTINCT Race FROM obs) CROSS JOIN (SELECT DISTINCT Gender FROM obs)
              CROSS JOIN (SELECT DISTINCT Age FROM obs)) g
        LEFT JOIN obs o ON g.Race IS NOT DISTINCT FROM o.Race AND g.Gender IS NOT DISTINCT FROM o.Gender
                       AND g.Age IS NOT DISTINCT FROM o.Age)""",
    r"""relabelled AS (SELECT Race, Gender,
          split_part(s, ',', 1) || ' to ' || CAST(CAST(split_part(s, ',', 2) AS INT) - 1 AS VARCHAR) AS Age,
          n AS case_count
        FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(Age, '\[|\)|\]', '', 'g'),
                                                      '^ ', ''), ', ', ',', 'g') AS s FROM complete))""",
    """case_side AS (
        SELECT Race, CASE Gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE Gender END AS Gender,
               Age, case_count FROM (
          SELECT Race, Gender, Age, case_count FROM relabelled
          WHERE Age <> '15 to 19' AND Age NOT IN ('85 to 89', '90 to 94', '95 to 99')
          UNION ALL
          SELECT Race, Gender, '85 and older' AS Age, CAST(sum(case_count) AS BIGINT) AS case_count FROM relabelled
          WHERE Age IN ('85 to 89', '90 to 94', '95 to 99') GROUP BY Race, Gender))""",
)
oracle("count_complete", with_ctes(*CASE_SIDE_CTES[:5], body="SELECT * FROM complete"))
oracle("relabel_age", with_ctes(*CASE_SIDE_CTES, body="SELECT * FROM case_side"))

PYRAMID_CTES = (*POP_CTES, DETAIL_CTE, MERGED_CTE, REF_CTE, *CASE_SIDE_CTES, """
pyramid_long AS (
    SELECT Age, Gender, Race, 'reference' AS "Group", ref_count AS Value
    FROM reference JOIN case_side USING (Age, Gender, Race)
    UNION ALL
    SELECT Age, Gender, Race, 'cases' AS "Group", case_count AS Value
    FROM reference JOIN case_side USING (Age, Gender, Race))""", """
pyramid AS (
    SELECT Age, Gender, Race, "Group",
           CAST(CASE WHEN Gender = 'Male' THEN -Value ELSE Value END AS BIGINT) AS Value,
           CAST(sum(Value) OVER (PARTITION BY Race, "Group") AS BIGINT) AS Total,
           CASE WHEN Gender = 'Male' THEN -(100.0 * CAST(Value AS DOUBLE)
                    / CAST(sum(Value) OVER (PARTITION BY Race, "Group") AS DOUBLE))
                ELSE 100.0 * CAST(Value AS DOUBLE)
                    / CAST(sum(Value) OVER (PARTITION BY Race, "Group") AS DOUBLE) END AS Proportion
    FROM pyramid_long)""")
oracle("population_compare", with_ctes(*PYRAMID_CTES, body="SELECT * FROM pyramid"))
oracle("group_composition", with_ctes(*PYRAMID_CTES, body="""
SELECT Race, CASE "Group" WHEN 'reference' THEN 'Reference population' WHEN 'cases' THEN 'Case population' ELSE "Group" END AS "Group",
       Total, 100.0 * CAST(Total AS DOUBLE) / CAST(sum(Total) OVER (PARTITION BY "Group") AS DOUBLE) AS Proportion
FROM (SELECT Race, "Group", CAST(sum(abs(Value)) AS BIGINT) AS Total FROM pyramid GROUP BY Race, "Group")"""))
oracle("actual_vs_expected", with_ctes(*PYRAMID_CTES, """
per_race AS (SELECT Race,
      CAST(sum(abs(Value)) FILTER (WHERE "Group" = 'cases') AS BIGINT) AS observed,
      CAST(sum(abs(Value)) FILTER (WHERE "Group" = 'reference') AS BIGINT) AS ref
    FROM pyramid GROUP BY Race)""", body="""
SELECT Race, observed, reference_share, expected, observed - expected AS difference,
       observed / expected AS ratio
FROM (SELECT Race, observed,
             CAST(ref AS DOUBLE) / CAST((SELECT sum(ref) FROM per_race) AS DOUBLE) AS reference_share,
             CAST((SELECT sum(observed) FROM per_race) AS DOUBLE)
               * (CAST(ref AS DOUBLE) / CAST((SELECT sum(ref) FROM per_race) AS DOUBLE)) AS expected
      FROM per_race)"""))


# ---- extensions over episodes ------------------------------------------

from snapcase.plans.oracles import EPISODE_CTES, periods_cte  # noqa: E402

_ATTR_CTE = f"""attrs AS (
    SELECT BookingNumber, BookingDate, RaceDescription, Gender, {cut_sql('CurrentAge')} AS age_group,
           CASE WHEN fel THEN 'FELONY' ELSE ChargeCategory END AS category
    FROM (SELECT *, bool_or(ChargeCategory = 'FELONY')
                      OVER (PARTITION BY BookingNumber, BookingDate) AS fel FROM cases)
    QUALIFY row_number() OVER (PARTITION BY BookingNumber, BookingDate
      ORDER BY SnapshotDateTime, RaceDescription NULLS FIRST, Gender NULLS FIRST,
               CurrentAge NULLS FIRST, ChargeCategory NULLS FIRST) = 1)"""
_STAYS = ("""held AS (
    SELECT BookingNumber, BookingDate, CAST(BookingDate AS DATE) AS start_day,
           coalesce(min(CAST(SnapshotDateTime AS DATE)) FILTER (WHERE ChargeDisposition IS NOT NULL),
                    max(CAST(SnapshotDateTime AS DATE)) + 1) AS end_day
    FROM cases GROUP BY BookingNumber, BookingDate)""", """stays AS (
    SELECT * FROM held
    WHERE start_day >= (SELECT min(CAST(SnapshotDateTime AS DATE)) FROM sj) AND end_day >= start_day)""")
_SPANS = """spans AS (SELECT a.*, datediff('day', start_day, end_day) AS days
    FROM stays JOIN attrs a USING (BookingNumber, BookingDate))"""
_LONG = """long AS (
    SELECT 'All' AS dimension, 'All' AS level, days FROM spans
    UNION ALL SELECT 'Race', CAST(RaceDescription AS VARCHAR), days FROM spans
    UNION ALL SELECT 'Gender', CAST(Gender AS VARCHAR), days FROM spans
    UNION ALL SELECT 'Age', CAST(age_group AS VARCHAR), days FROM spans
    UNION ALL SELECT 'Category', CAST(category AS VARCHAR), days FROM spans)"""
oracle("pretrial_days", with_ctes(CASES_CTE, EPISODE_CTES, _ATTR_CTE, *_STAYS, _SPANS, _LONG, body="""
SELECT dimension, level, count(*) AS bookings, CAST(sum(days) AS BIGINT) AS total_days,
       CAST(sum(days) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_days
FROM long GROUP BY dimension, level"""))

oracle("booking_days_cost", with_ctes(CASES_CTE, EPISODE_CTES, *_STAYS, periods_cte(), f"""
per AS (SELECT p.name AS period,
          datediff('day', greatest(e.start_day, p.p_start), least(e.end_day, p.p_end + 1)) AS days
        FROM stays e CROSS JOIN periods p)""", body=f"""
SELECT period, count(*) AS bookings, CAST(sum(days) AS BIGINT) AS booking_days,
       CAST(sum(days) * {P.DAY_RATE} AS BIGINT) AS cost
FROM per WHERE days > 0 GROUP BY period"""))

oracle("daily_pretrial_headcount", with_ctes(CASES_CTE, """
pbd AS (SELECT CAST(SnapshotDateTime AS DATE) AS day, BookingNumber, BookingDate,
               min(CAST(ChargeDisposition IS NULL AS INT)) AS only_pretrial
        FROM cases GROUP BY ALL)""", """
pd AS (SELECT day, count(*) AS held, sum(only_pretrial) AS pretrial_only FROM pbd GROUP BY day)""",
                                             body="""
SELECT strftime(day, '%Y-%m') AS month, count(*) AS days,
       CAST(sum(held) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_held,
       CAST(sum(pretrial_only) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_pretrial_only
FROM pd GROUP BY month"""))

oracle("group_combinations_by_race", with_ctes(CASES_CTE, """
eg AS (SELECT DISTINCT BookingNumber, BookingDate, RaceDescription AS race, ChargeGroup AS charge_group
       FROM cases WHERE ChargeGroup IS NOT NULL)""", f"""
anch AS (SELECT BookingNumber, BookingDate, race FROM eg WHERE charge_group = {_X})""", """
per_race AS (SELECT race, count(*) AS anchor_episodes FROM anch GROUP BY race)""", body=f"""
SELECT e.race, charge_group, count(*) AS episodes, anchor_episodes,
       CAST(count(*) AS DOUBLE) / CAST(anchor_episodes AS DOUBLE) AS share
FROM (SELECT eg.* FROM eg JOIN anch a ON eg.BookingNumber = a.BookingNumber
        AND eg.BookingDate = a.BookingDate AND eg.race IS NOT DISTINCT FROM a.race) e
JOIN per_race p ON e.race IS NOT DISTINCT FROM p.race
WHERE charge_group <> {_X} GROUP BY e.race, charge_group, anchor_episodes"""))

oracle("warrant_share", with_ctes(CASES_CTE, f"""
pe AS (SELECT BookingNumber, BookingDate, RaceDescription AS race,
              max(CAST(ChargeGroup = {q(P.WARRANT_GROUP)} AS INT)) AS w
       FROM cases GROUP BY BookingNumber, BookingDate, RaceDescription)""", body="""
SELECT race, count(*) AS bookings, CAST(coalesce(sum(w), 0) AS BIGINT) AS with_warrant,
       CAST(coalesce(sum(w), 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share
FROM pe GROUP BY race"""))

oracle("initial_and_final_charges", with_ctes(CASES_CTE, """
span AS (SELECT BookingNumber, BookingDate, min(SnapshotDateTime) AS f, max(SnapshotDateTime) AS l
         FROM cases GROUP BY BookingNumber, BookingDate)""", """
r AS (SELECT c.BookingNumber, c.BookingDate, coalesce(c.ChargeGroup, 'Missing') AS charge_group,
             CAST(c.SnapshotDateTime = s.f AS INT) AS b, CAST(c.SnapshotDateTime = s.l AS INT) AS r
      FROM cases c JOIN span s ON c.BookingNumber = s.BookingNumber AND c.BookingDate = s.BookingDate)""",
                                              """
pe AS (SELECT BookingNumber, BookingDate, charge_group, max(b) AS b, max(r) AS r FROM r
       WHERE b = 1 OR r = 1 GROUP BY ALL)""", body="""
SELECT charge_group, CAST(sum(b) AS BIGINT) AS at_booking, CAST(sum(r) AS BIGINT) AS at_release
FROM pe GROUP BY charge_group"""))

oracle("result_tables", with_ctes(*FLAGS_CTES, body="""
SELECT race, traffic, drugs, other, count(*) AS freq FROM flags GROUP BY ALL"""))


# ---- stratified models and the literal item grain ----------------------

_YEAR = "CAST(year(BookingDate) AS INTEGER)"
oracle("loglinear_fit_by_year", _loglinear_sql(strata=_YEAR))
oracle("odds_ratio_by_year", with_ctes(*flags_ctes(_YEAR), cells_cte(True),
                                       f"odds AS ({_odds_sql(True)})", body=f"""
SELECT booking_year, orientation, given_level, {rnd('odds_ratio')} AS odds_ratio, {rnd('lwr')} AS lwr,
       {rnd('upr')} AS upr, (lwr <= 1.0 AND upr >= 1.0) AS contains_one FROM odds"""))

ITEM_GRAIN_CTES = (
    CASES_CTE,
    f"""bi AS (SELECT DISTINCT BookingNumber, BookingDate, Charge, ChargeGroup FROM cases
        WHERE ChargeGroup IN ({_X}, {_Y}) AND Charge IS NOT NULL)""",
    "nb AS (SELECT count(*) AS n FROM (SELECT DISTINCT BookingNumber, BookingDate, Charge FROM bi))",
    f"mx AS (SELECT Charge AS x_item, count(*) AS mx FROM bi WHERE ChargeGroup = {_X} GROUP BY 1)",
    f"my AS (SELECT Charge AS y_item, count(*) AS my FROM bi WHERE ChargeGroup = {_Y} GROUP BY 1)",
    f"""co AS (SELECT a.Charge AS x_item, b.Charge AS y_item, count(*) AS n11
        FROM bi a JOIN bi b ON a.BookingNumber = b.BookingNumber AND a.BookingDate = b.BookingDate
         AND a.Charge = b.Charge
        WHERE a.ChargeGroup = {_X} AND b.ChargeGroup = {_Y} GROUP BY 1, 2)""",
    PAIR_CTES[-1],
)
oracle("item_pair_contingency_item_grain", with_ctes(*ITEM_GRAIN_CTES, body="SELECT * FROM pairs"))

_GRID2 = f"""grid AS (SELECT * FROM (VALUES ({q(P.RACE_A)}, 0), ({q(P.RACE_B)}, 1)) r(race, ri)
   CROSS JOIN (VALUES ('Yes', 0), ('No', 1)) o(traffic, oi)
   CROSS JOIN (VALUES ('No', 0), ('Yes', 1)) g(drugs, gi))"""
oracle("xtab3_given_drugs", with_ctes(*FLAGS_CTES, _GRID2, _XTAB, body="SELECT * FROM xt"))
