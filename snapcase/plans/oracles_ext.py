"""Oracle SQL for the general and incremental forms of the operators (registered into
:mod:`snapcase.plans.oracles`).  The constants are written out, not imported."""

from __future__ import annotations

from snapcase.plans import params as P
from snapcase.plans.oracles import (_ORACLES, ATTRS, CASE_VIEW, CASES_CTE, EPISODE_CTES, TITLED, _pct_sql, counts_sql,
                                    cut_sql, first_sql, oracle, q, shares_sql, suffix_sql, with_ctes)
from snapcase.plans.oracles_more import _SPANS, _STAYS, _ATTR_CTE, V_CTES, flags_ctes, gamma_q_half_sql, rnd

oracle("significant_pairs", with_ctes(*V_CTES, body=f"""
SELECT x_item, y_item, n11, n10, n01, n00, n, chi2, {rnd('p_value')} AS p_value, cramers_v
FROM v WHERE cramers_v IS NOT NULL"""))

# Every episode lists its groups; sets grow from the anchor by a larger group each time.
oracle("group_itemsets_by_race", with_ctes(CASES_CTE, f"""held AS (
    SELECT DISTINCT BookingNumber, BookingDate, RaceDescription AS race, ChargeGroup AS g
    FROM cases WHERE ChargeGroup IS NOT NULL)""", f"""sets AS (
    SELECT BookingNumber, BookingDate, race, [g] AS items, '' AS last FROM held WHERE g = {q(P.DRUG_GROUP)}
    UNION ALL
    SELECT s.BookingNumber, s.BookingDate, s.race, list_append(s.items, h.g), h.g
    FROM sets s JOIN held h ON h.BookingNumber = s.BookingNumber AND h.BookingDate = s.BookingDate
     AND h.race IS NOT DISTINCT FROM s.race AND h.g > s.last AND h.g <> {q(P.DRUG_GROUP)})""",
    "counted AS (SELECT race, list_sort(items) AS items, count(*) AS episodes FROM sets GROUP BY ALL)",
    "alone AS (SELECT race, episodes AS n FROM counted WHERE len(items) = 1)", body="""
SELECT c.race, array_to_string(items, ' + ') AS combination, len(items) AS size, episodes,
       CAST(episodes AS DOUBLE) / CAST(n AS DOUBLE) AS share
FROM counted c JOIN alone a ON a.race IS NOT DISTINCT FROM c.race WHERE episodes >= 5"""
    ).replace("WITH ", "WITH RECURSIVE ", 1))

_LIFE = (CASES_CTE, EPISODE_CTES, _ATTR_CTE, *_STAYS, _SPANS, """marked AS (
    SELECT s.*, bool_or(c.ChargeDisposition IS NOT NULL) AS ended
    FROM spans s JOIN cases c USING (BookingNumber, BookingDate) GROUP BY ALL)""", """steps AS (
    SELECT RaceDescription, CAST(days AS BIGINT) AS days, count(*) FILTER (WHERE ended) AS ended,
           count(*) FILTER (WHERE NOT ended) AS censored,
           row_number() OVER (PARTITION BY RaceDescription ORDER BY days) AS i
    FROM marked GROUP BY RaceDescription, days)""", """risky AS (
    SELECT s.*, (SELECT count(*) FROM marked m WHERE m.RaceDescription IS NOT DISTINCT FROM s.RaceDescription
                 AND m.days >= s.days) AS at_risk FROM steps s)""", """curve AS (
    SELECT *, (1.0 - CAST(ended AS DOUBLE) / at_risk) AS survival FROM risky WHERE i = 1
    UNION ALL
    SELECT r.*, c.survival * (1.0 - CAST(r.ended AS DOUBLE) / r.at_risk)
    FROM curve c JOIN risky r ON r.RaceDescription IS NOT DISTINCT FROM c.RaceDescription AND r.i = c.i + 1)""")
oracle("pretrial_survival", with_ctes(*_LIFE, body="""
SELECT RaceDescription, days, at_risk, ended, censored, round(survival, 8) AS survival FROM curve"""
    ).replace("WITH ", "WITH RECURSIVE ", 1))
oracle("pretrial_survival_summary", with_ctes(*_LIFE, f"""areas AS (
    SELECT *, survival * greatest(0, least(coalesce(lead(days) OVER w, {P.HORIZON_DAYS}), {P.HORIZON_DAYS}) - days) AS area
    FROM curve WINDOW w AS (PARTITION BY RaceDescription ORDER BY days))""", body=f"""
SELECT RaceDescription, max(at_risk) AS bookings, CAST(sum(ended) AS BIGINT) AS ended,
       min(days) FILTER (WHERE survival <= 0.5 + 1e-9) AS median_days,
       round(least(min(days), {P.HORIZON_DAYS}) + sum(area), 8) AS restricted_mean
FROM areas GROUP BY RaceDescription""").replace("WITH ", "WITH RECURSIVE ", 1))

oracle("booking_days_rolling", with_ctes(CASES_CTE, EPISODE_CTES, *_STAYS, f"""periods AS (
    SELECT DISTINCT CAST(date_trunc('month', start_day) AS DATE) AS a,
           CAST(date_trunc('month', start_day) AS DATE) + {P.ROLLING_DAYS} AS b FROM stays)""", """per AS (
    SELECT a, datediff('day', greatest(start_day, a), least(end_day, b)) AS days
    FROM stays JOIN periods ON start_day < b AND a < end_day WHERE start_day < end_day)""", body=f"""
SELECT strftime(a, '%Y-%m-%d') AS period, count(*) AS bookings, CAST(sum(days) AS BIGINT) AS booking_days,
       CAST(sum(days) * {P.DAY_RATE} AS BIGINT) AS cost FROM per GROUP BY a"""))

oracle("daily_headcount_from_stays", with_ctes(CASES_CTE, EPISODE_CTES, *_STAYS, """calendar AS (
    SELECT CAST(unnest(generate_series(min(start_day), max(end_day), INTERVAL 1 DAY)) AS DATE) AS day
    FROM stays WHERE start_day < end_day)""", body="""
SELECT day, count(start_day) AS held
FROM calendar LEFT JOIN stays ON start_day <= day AND day < end_day GROUP BY day"""))


def p_any_sql(x: str, df: int) -> str:
    """Upper tail of chi-square, by the finite sums for whole and half arguments."""
    if df == 0:
        return "CAST(1.0 AS DOUBLE)"
    z = f"(({x}) / 2.0)"
    half = 0.5 if df % 2 else 0.0
    terms = [f"exp({half + i} * ln({z}) - {z} - lgamma({half + i + 1.0}))" for i in range(df // 2)]
    start = [gamma_q_half_sql(z)] if df % 2 else []
    return f"CASE WHEN ({x}) <= 0 THEN 1.0 ELSE least(1.0, {' + '.join(start + terms)}) END"


def _table_ctes(name: str, a: str, b: str) -> str:
    return f"""{name} AS (
    SELECT *, (obs - e) * (obs - e) / e AS part FROM (
      SELECT r.y, r.a, c.b, n, coalesce(obs, 0) AS obs, CAST(nr AS DOUBLE) * nc / n AS e
      FROM (SELECT year(BookingDate) AS y, {a} AS a, count(*) AS nr FROM cases
            WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) r
      JOIN (SELECT year(BookingDate) AS y, {b} AS b, count(*) AS nc FROM cases
            WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) c ON r.y = c.y
      JOIN (SELECT year(BookingDate) AS y, count(*) AS n FROM cases
            WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) t ON t.y = r.y
      LEFT JOIN (SELECT year(BookingDate) AS y, {a} AS a, {b} AS b, count(*) AS obs FROM cases GROUP BY ALL) o
        ON o.y = r.y AND o.a = r.a AND o.b = c.b))"""


_TABS = (("race_by_group", "RaceDescription", "ChargeGroup"), ("gender_by_category", "Gender", "ChargeCategory"),
         ("marital_by_disposition", "MaritalStatus", "ChargeDisposition"))
_P_CASES = " ".join(f"WHEN {d} THEN {p_any_sql('chi2', d)}" for d in range(1, 25))
oracle("association_tables", with_ctes(
    CASES_CTE, *(_table_ctes(*t) for t in _TABS), "dense AS (" + "\n UNION ALL ".join(
        f"""SELECT {q(t)} AS tab, CAST(y AS INTEGER) AS booking_year, CAST(max(n) AS BIGINT) AS n,
               count(DISTINCT a) AS rows, count(DISTINCT b) AS cols,
               CASE WHEN count(DISTINCT a) = 2 AND count(DISTINCT b) = 2
                    THEN sum(power(abs(obs - e) - least(0.5, abs(obs - e)), 2) / e) ELSE sum(part) END AS chi2
        FROM {t} GROUP BY y""" for t, _, _ in _TABS) + ")", body=f"""
SELECT tab, booking_year, n, rows, cols, df, round(chi2, 7) AS chi2,
       round(CASE df {_P_CASES} END, 7) AS p_value,
       round(CASE WHEN least(rows, cols) > 1 THEN sqrt(chi2 / (n * (least(rows, cols) - 1.0))) END, 7) AS cramers_v
FROM (SELECT *, (rows - 1) * (cols - 1) AS df FROM dense)"""))

# Proportional fitting on the long table: each cycle scales to the three margins in turn.
_MARGINS = {
    "independence": "sum(n) OVER (PARTITION BY race) * sum(n) OVER (PARTITION BY drugs) "
                    "* sum(n) OVER (PARTITION BY traffic) / (sum(n) OVER () * sum(n) OVER ())",
    "joint_dt_r": "sum(n) OVER (PARTITION BY drugs, traffic) * sum(n) OVER (PARTITION BY race) / sum(n) OVER ()",
    "conditional_dt_dr": "sum(n) OVER (PARTITION BY drugs, traffic) * sum(n) OVER (PARTITION BY drugs, race) "
                         "/ sum(n) OVER (PARTITION BY drugs)",
    "conditional_dt_tr": "sum(n) OVER (PARTITION BY drugs, traffic) * sum(n) OVER (PARTITION BY traffic, race) "
                         "/ sum(n) OVER (PARTITION BY traffic)",
    "saturated": "n",
}
_DF = {"independence": 13, "joint_dt_r": 12, "conditional_dt_dr": 8, "conditional_dt_tr": 8,
       "homogeneous": 4, "saturated": 0}
_FLAGS5 = [c.replace(f"RaceDescription IN ('{P.RACE_A}', '{P.RACE_B}')", "RaceDescription IS NOT NULL")
           for c in flags_ctes()]
_SCALE = "CASE WHEN sum(m) OVER w = 0 THEN 0.0 ELSE m * sum(n) OVER w / sum(m) OVER w END"


def _fit(source: str, by: str) -> str:
    return (f"SELECT race, drugs, traffic, n, {_SCALE} AS m, cycle FROM {source} "
            f"WINDOW w AS (PARTITION BY cycle, {by})")


oracle("loglinear_all_races", with_ctes(*_FLAGS5, """cells AS (
    SELECT r.race, d.drugs, t.traffic, CAST(coalesce(n, 0) AS DOUBLE) AS n
    FROM (SELECT DISTINCT race FROM flags) r CROSS JOIN (SELECT DISTINCT drugs FROM flags) d
    CROSS JOIN (SELECT DISTINCT traffic FROM flags) t
    LEFT JOIN (SELECT race, drugs, traffic, count(*) AS n FROM flags GROUP BY ALL) f
      ON f.race = r.race AND f.drugs = d.drugs AND f.traffic = t.traffic)""", f"""ipf AS (
    SELECT race, drugs, traffic, n, CAST(1.0 AS DOUBLE) AS m, 0 AS cycle FROM cells
    UNION ALL
    SELECT race, drugs, traffic, n, m, cycle + 1 FROM (
      {_fit('(' + _fit('(' + _fit('ipf', 'drugs, traffic') + ')', 'drugs, race') + ')', 'traffic, race')})
    WHERE cycle < 60)""", "models AS (" + "\n UNION ALL ".join(
    [f"SELECT {q(k)} AS model, {_DF[k]} AS df, n, CAST({v} AS DOUBLE) AS m FROM cells" for k, v in _MARGINS.items()]
    + [f"SELECT 'homogeneous', {_DF['homogeneous']}, n, m FROM ipf WHERE cycle = 60"]) + ")", """stats AS (
    SELECT model, df, greatest(0.0, 2 * sum(CASE WHEN n > 0 THEN n * ln(n / m) ELSE 0 END)) AS g2,
           sum(CASE WHEN m > 0 THEN (n - m) * (n - m) / m ELSE 0 END) AS x2 FROM models GROUP BY ALL)""",
    body="SELECT model, CAST(df AS BIGINT) AS df, round(g2, 7) AS g2, round(x2, 7) AS x2, " + ", ".join(
        "round(CASE df " + " ".join(f"WHEN {d} THEN {p_any_sql(x, d)}" for d in sorted(set(_DF.values())))
        + f" END, 7) AS p_{x}" for x in ("g2", "x2")) + " FROM stats").replace("WITH ", "WITH RECURSIVE ", 1))

# Poisson(1) levels of a 16-bit draw, from the published distribution.
_LEVELS = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)
_DRAW = "CAST('0x' || substr(md5(c || ':' || (r // 8)), 4 * (r % 8) + 1, 4) AS BIGINT)"
oracle("race_share_intervals", with_ctes(CASES_CTE, """clusters AS (
    SELECT RaceDescription, CAST(BookingNumber AS VARCHAR) AS c, count(*) AS n FROM cases GROUP BY ALL)""", f"""
draws AS (SELECT RaceDescription, n, r, {_DRAW} AS u FROM clusters, (SELECT unnest(range(48)) AS r))""", f"""
sums AS (SELECT RaceDescription, r, sum(n * ({' + '.join(f'CAST(u >= {x} AS BIGINT)' for x in _LEVELS)})) AS s
         FROM draws GROUP BY ALL)""", """shares AS (
    SELECT RaceDescription, CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY r) AS DOUBLE) AS share FROM sums)""", """
sorted AS (SELECT RaceDescription, list_sort(list(share)) AS l FROM shares GROUP BY 1)""", """
whole AS (SELECT RaceDescription, CAST(sum(n) AS BIGINT) AS n,
                 CAST(sum(n) AS DOUBLE) / CAST(sum(sum(n)) OVER () AS DOUBLE) AS share FROM clusters GROUP BY 1)""", body="""
SELECT w.RaceDescription, n, round(share, 8) AS share, round(l[2], 8) AS lower, round(l[47], 8) AS upper
FROM whole w JOIN sorted s ON s.RaceDescription IS NOT DISTINCT FROM w.RaceDescription"""))

_ORACLES["episode_state"] = _ORACLES["first_obs_per_episode"]

_MONTH_CTES = (
    CASES_CTE, EPISODE_CTES,
    f"""ex AS (SELECT *, {cut_sql('CurrentAge')} AS age_group FROM exposure
        WHERE year(SnapshotDateTime) = {P.YEAR} AND ChargeCategory IN ('FELONY', 'MISDEMEANOR'))""",
    "first_rows AS (" + first_sql("ex", ["BookingNumber", "BookingDate", "ChargeCategory"],
                                  ["SnapshotDateTime"], ATTRS) + ")",
    f"m AS (SELECT *, monthname(SnapshotDateTime) || '_' || {suffix_sql('ChargeCategory')} AS col "
    "FROM first_rows)",
    "counts AS (" + counts_sql("m", TITLED, by=["col"]) + ")",
    "shares AS (" + shares_sql("counts", ["col"]) + ")",
)
_MONTH_TEXT = []
for _m in ("January", "February", "March", "April", "May", "June", "July",
           "August", "September", "October", "November", "December"):
    _fel, _mis = (f"coalesce(max({_pct_sql('n', 'denom', 1)}) FILTER (WHERE col = {q(_m + s)}), '0.0%')"
                  for s in ("_fel", "_mis"))
    _MONTH_TEXT.append(f"{_fel} || '<br>(' || {_mis} || ')' AS {_m}")
oracle("share_display_monthly", with_ctes(*_MONTH_CTES, body=(
    f"SELECT groupname, rowname, {', '.join(_MONTH_TEXT)} FROM shares GROUP BY groupname, rowname")))

_ORACLES["snapshot_scan_csv"] = _ORACLES["snapshot_scan"]
oracle("snapshot_rejects", with_ctes(f"""written AS (SELECT BookingNumber % 97 = 0 AS bad_age,
        BookingNumber % 89 = 0 AS bad_day, CurrentAge FROM ({CASE_VIEW}))""", """found AS (
    SELECT 'CurrentAge' AS "column", 'age ' || CurrentAge AS text FROM written WHERE bad_age
    UNION ALL SELECT 'SnapshotDateTime', 'some day' FROM written WHERE bad_day)""", body="""
SELECT "column", text, count(*) AS cells, (SELECT count(*) FROM written) AS rows,
       (SELECT count(*) FROM written WHERE NOT bad_age) AS ages,
       (SELECT count(*) FROM written WHERE NOT bad_day) AS days
FROM found GROUP BY ALL"""))

# ---- the same oracles over a table with awkward values -----------------------

_COMMON = ", ".join(f"'{{g}} Brand#{i}'" for i in range(1, 6))
EDGE_VIEW = f"""
SELECT BookingNumber, BookingDate, SnapshotDateTime,
       CASE WHEN BookingNumber % 101 = 0 THEN 238 WHEN CurrentAge >= 60 THEN CurrentAge + 33
            ELSE CurrentAge END AS CurrentAge, Gender,
       CASE WHEN BookingNumber % 53 = 0 THEN NULL WHEN BookingNumber % 59 = 0 THEN 'UNKNOWN'
            ELSE RaceDescription END AS RaceDescription, MaritalStatus, ChargeGroup,
       CASE WHEN BookingNumber % 67 = 0 THEN NULL
            WHEN BookingNumber % 2 = 0 AND Charge IN ({_COMMON.format(g='PROMO')}) THEN 'PROMO common'
            WHEN BookingNumber % 2 = 1 AND Charge IN ({_COMMON.format(g='ECONOMY')}) THEN 'ECONOMY common'
            ELSE Charge END AS Charge, ChargeCategory, ChargeDisposition FROM ({CASE_VIEW})"""
_EDGE_CTE = f"cases AS (SELECT * FROM ({EDGE_VIEW}) WHERE CurrentAge <> 238)"
for _edge, _base in (("edge_recode_group", "recode_group"), ("edge_profile_counts", "profile_counts"),
                     ("edge_count_complete", "count_complete"), ("edge_relabel_age", "relabel_age"),
                     ("edge_cramers_v", "cramers_v"), ("edge_significant_pairs", "significant_pairs"),
                     ("edge_assoc_topk", "assoc_topk"), ("edge_pretrial_days", "pretrial_days"),
                     ("edge_group_itemsets", "group_itemsets_by_race")):
    _ORACLES[_edge] = _ORACLES[_base].replace(CASES_CTE.strip(), _EDGE_CTE)
_ORACLES["edge_relabel_age_published"] = _ORACLES["edge_relabel_age"].replace(
    "('85 to 89', '90 to 94', '95 to 99')", "('85 to 89', '95 to 99')")
