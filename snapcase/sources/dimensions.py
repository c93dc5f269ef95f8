"""Small dimension tables: category short names (C03) and reporting periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Category name -> short display name, in the order published
# with the original analysis (65 rows).
CATEGORY_SHORT_NAMES = [
    ("MURDER", "MURDER"),
    ("DRUGS", "DRUGS"),
    ("ENDANGERMENT", "ENDANGERMENT"),
    ("DV PROTECTIVE ORDER", "DV PRO. ORD."),
    ("FORGERY", "FORGERY"),
    ("HINDERING/INTIMIDATING", "INTIMIDATING"),
    ("THEFT", "THEFT"),
    ("NON SUPPORT", "NON SUPPORT"),
    ("PROBATION/PAROLE VIOLATION", "PROB/PRLE VIO."),
    ("KIDNAPPING", "KIDNAPPING"),
    ("ROBBERY", "ROBBERY"),
    ("TRAFFIC", "TRAFFIC"),
    ("GENERAL MISDEMEANOR", "GEN MISDEM."),
    ("ASSAULT", "ASSAULT"),
    ("CUSTODIAL INTERFERENCE", "CUST. INTERF."),
    ("TERORISTIC THREATS", "TERRORIS. THREATS"),
    ("CRIMINAL MISCHIEF", "CRIM. MISCHIEF"),
    ("GENERAL FELONY", "GEN FEL."),
    ("ELUDING", "ELUDING"),
    ("TRESPASSING", "TRESPASSING"),
    ("CONTEMPT OF COURT", "CON. OF COURT"),
    ("WEAPONS", "WEAPONS"),
    ("ORDINANCE VIOLATIONS", "ORDIN. VIO."),
    ("DUI", "DUI"),
    ("VIOL CONDITION OF RELEASE", "VIOL COND. OF REL."),
    ("LOITERING", "LOITERING"),
    ("BAIL JUMPING", "BAIL JUMPING"),
    ("FUGITIVE ESCAPE", "FUGITIVE ESCAPE"),
    ("ORGANIZED CRIME", "ORGANIZED CRIME"),
    ("SEXUAL ABUSE", "SEXUAL ABUSE"),
    ("DISTURBING THE PEACE", "DIST. PEACE"),
    ("ARSON", "ARSON"),
    ("FRAUD", "FRAUD"),
    ("WARRANT", "WARRANT"),
    ("ALCOHOL", "ALCOHOL"),
    ("OTHER", "OTHER"),
    ("MENACING", "MENACING"),
    ("SHOCK PROBATION", "SHOCK PROB."),
    ("RAPE", "RAPE"),
    ("ABUSE NEGLECT", "ABUSE NEG."),
    ("DISORDERLY CONDUCT", "DISORD. COND."),
    ("PROSTITUTION", "PROSTITUTION"),
    ("PROBATION/PAROLE VIOLATION MIS", "PROB/PRLE VIO. MIS"),
    ("FLAGRANT NON SUPPORT", "FLAG. NON SUPPOT"),
    ("ANIMALS", "ANIMALS"),
    ("HUNTING AND FISHING", "HUNT/FISH"),
    ("VOYERISM", "VOYERISM"),
    ("STALKING", "STALKING"),
    ("SEX OFFENDER", "SEX OFFENDER"),
    ("BRIBERY", "BRIBERY"),
    ("GAMBLING", "GAMBLING"),
    ("HARASSMENT", "HARASSMENT"),
    ("INDECENT EXPOSURE", "INDEC EXP."),
    ("ELUDING/RESISTING", "RESISTING"),
    ("BURGLARY", "BURGLARY"),
    ("FUGITIVE/ESCAPE", "ESCAPE"),
    ("FELONY PROMOTING CONTRABAND", "FEL PROMOT. CONTRIB."),
    ("PORNOGRAPHY", "PORNOGRAPHY"),
    ("FELONY FRAUD", "FELONY FRAUD"),
    ("VIOL CONDITIONAL RELEASE", "VIOL COND. OF REL."),
    ("ABUSE/NEGLECT", "ABUSE NEG."),
    ("PROMOTING CONTRABAND", "PROMOTING CON."),
    ("CHILD ENDANGERMENT", "CHILD ENDANG."),
    ("PROMOTING CONTRA BAND", "PROMOTING CON."),
    ("FELONY OTHER", "FEL OTHER"),
]


def category_dimension(spark: SparkSession, rows=None) -> DataFrame:
    """Long -> short category names as a DataFrame (65 rows unless given).

    Built JVM-side from literals (``inline`` over one row), so the planner
    knows its size; a Python-list DataFrame would be an opaque RDD scan.
    """
    rows = list(rows if rows is not None else CATEGORY_SHORT_NAMES)
    structs = [F.struct(F.lit(a).alias("ChargeGroup"), F.lit(b).alias("ChargeGroupShort"))
               for a, b in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def period(name: str, start: str, end: str) -> tuple[str, dt.date, dt.date]:
    """A named, inclusive date range used to split snapshot days."""
    return (name, dt.date.fromisoformat(start), dt.date.fromisoformat(end))
