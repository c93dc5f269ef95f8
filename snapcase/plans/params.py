"""Parameters that bind the generic operators to the driver's test tables.

The case view maps orders to bookings and line items to charges (see
FIXTURES.md F6).  These values pick the roles of that mapping: which
segments play the two compared races, which part types are the drug and
traffic groups, and the reporting year and fiscal periods inside the data's
1995-2001 range.
"""

from __future__ import annotations

from snapcase.sources.dimensions import period

YEAR = 1997
PERIODS = (period("9798", "1997-07-01", "1998-06-30"),
           period("9899", "1998-07-01", "1999-06-30"))
CATEGORIES = (("FELONY", "fel"), ("MISDEMEANOR", "mis"))

DRUG_GROUP = "PROMO"
TRAFFIC_GROUP = "ECONOMY"
RACE_A = "AUTOMOBILE"       # first level (rows of the odds ratios)
RACE_B = "BUILDING"
RESCUE_PATTERN = "MEDIUM Brand#1"   # NULL-group charges containing it become drugs
WARRANT_GROUP = "LARGE"
EXCLUDED_RACES = ("HOUSEHOLD",)     # analogue of the dropped "Other"/"UNKNOWN" levels
TOP_K = 20

# Item vocabulary of the two groups (charge = part type + brand, 25 brands).
BRANDS = tuple(f"Brand#{i}" for i in range(1, 26))
DRUG_ITEMS = tuple(sorted(f"{DRUG_GROUP} {b}" for b in BRANDS))
TRAFFIC_ITEMS = tuple(sorted(f"{TRAFFIC_GROUP} {b}" for b in BRANDS))

# Ordered category overrides for the recode operator; the repeated key checks
# that the last rule wins.
RECODE_RULES = (
    ("SMALL Brand#3", "PROMO"),
    ("SMALL Brand#4", "PROMO"),
    ("LARGE Brand#5", "ECONOMY"),
    ("PROMO Brand#7", "STANDARD"),
    ("MEDIUM Brand#2", "PROMO"),
    ("SMALL Brand#3", "ECONOMY"),
    ("STANDARD Brand#9", "ECONOMY"),
    ("MEDIUM Brand#6", "LARGE"),
)

# Short names for the part-type categories (the test analogue of the 65-row
# category dimension, which does not cover these names).
SHORT_NAMES = (("PROMO", "PRM"), ("ECONOMY", "ECO"), ("STANDARD", "STD"),
               ("SMALL", "SML"), ("LARGE", "LRG"))

# Population side: census-style labels of the derived estimates mapped onto
# the case view's segment labels.
POP_RACE_RECODE = {"Black alone": "AUTOMOBILE", "White alone": "BUILDING",
                   "American Indian and Alaska Native alone": "FURNITURE"}
POP_MERGE = (("Asian alone", "Native Hawaiian and Other Pacific Islander alone"), "HOUSEHOLD")
POP_ORIGIN_LABEL = "MACHINERY"      # the origin-built category plays this segment
CASE_EXCLUDED = ("Other", "UNKNOWN")
DAY_RATE = 82                       # cost of one booking-day

ALL_RACES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
MIN_EPISODES = 5                    # support of a combination of charge groups
HORIZON_DAYS = 365                  # of the restricted mean stay
ROLLING_DAYS = 90
