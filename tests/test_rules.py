"""Hand-derived cases for the per-row rules (FIXTURES section 6)."""

import pytest
from pyspark.sql import functions as F

from durata.functions import rules as R
from durata.operators import classify


def col1(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_age_to_years(spark):
    got = col1(spark, ["18 Years", "6 Months", "26 weeks", "73 days", "N/A (No limit)", "40", "12 Hours", None, " "],
               R.age_to_years)
    assert got[:4] == [18.0, 0.5, 0.5, 0.2]
    assert got[4] is None and got[5] == 40.0 and got[6] == 12.0 and got[7] is None and got[8] is None


def test_count_any_and_list_len(spark):
    assert col1(spark, ["a|b| |c", "7", " 7 ", "", None], R.count_any) == [3, 7, 1, 0, None]
    assert col1(spark, ["a||b", "a| |b"], R.list_len) == [2, 3]
    df = spark.createDataFrame([(["x", "y"],), (None,)], "x array<string>")
    assert [r[0] for r in df.select(R.count_any("x", is_array=True)).collect()] == [2, None]


def test_complexity_bucket(spark):
    assert col1(spark, [3, 4, 6, 7, None], R.complexity_bucket, "int") == ["Low", "Medium", "Medium", "High", None]


def test_n_elig_criteria(spark):
    got = col1(spark, ["* a\n- b\n\t• c", "p1\n\np2", "-a", "  ", None, "a\r- b"], R.n_elig_criteria)
    assert got[:5] == [3.0, 2.0, 1.0, None, None]
    assert got[5] == 1.0  # a carriage return is not a line break for the bullet rule


def test_browse_to_ta(spark):
    vals = ["Breast Cancer", "carcinoma", "Lung cancer", "heart failure", None, "Sjögren", "pediatric asthma",
            "Childhood obesity"]
    got = col1(spark, vals, lambda c: classify.first_match_expr(c, classify.THERAPEUTIC_AREAS))
    assert got == ["Oncology", "Other", "Oncology", "Cardiovascular", "Other", "Other", "Respiratory",
                   "Paediatrics"]  # "obesity" is not the whole word "obes" (Q4)


def test_countries(spark):
    df = spark.createDataFrame([([("a", "US"), ("b", "US"), ("c", ""), ("d", None), ("e", "FR")],), (None,)],
                               "s array<struct<f:string,country:string>>")
    assert [r[0] for r in df.select(R.count_unique_countries("s")).collect()] == [2, 0]
    assert [r[0] for r in df.select(R.count_sites("s")).collect()] == [5, 0]


def test_masking(spark):
    lv = col1(spark, ["Double Blind", "None (Open Label)", "foo", None], R.masking_level)
    assert lv == ["Double", "None", "Other", "None"]
    df = spark.createDataFrame([(x,) for x in lv], "x string")
    assert [r[0] for r in df.select(R.masking_flag("x")).collect()] == [1, 0, 0, 0]


def test_active_prob(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 3)], "p int, a int")
    assert [r[0] for r in df.select(R.active_prob("p", "a")).collect()] == [0.5, 1.0, 1.0]


def test_age_window(spark):
    df = spark.createDataFrame([(65.0, 18.0), (0.0, 10.0)], "lo double, hi double")
    lo, hi, rng = R.age_window("lo", "hi")
    assert [tuple(r) for r in df.select(lo, hi, rng).collect()] == [(18.0, 65.0, 47.0), (None, 10.0, None)]


def test_population(spark):
    df = spark.createDataFrame([("adult", None, None), ("adult child", None, None), ("pediatric", None, None),
                                ("x", 5.0, 17.0), ("x", 12.0, 40.0), (None, 20.0, 60.0)],
                               "t string, lo double, hi double")
    got = [r[0] for r in df.select(R.population_class("t", "lo", "hi")).collect()]
    assert got == ["Adult", "Mixed", "Unknown", "Pediatric", "Mixed", "Adult"]


def test_phase_allocation(spark):
    assert col1(spark, ["phase1", "EARLY PHASE 1", "EARLY_PHASE1", None], R.phase_label) == \
        ["Phase 1", "Phase 1", "Unknown", "Unknown"]
    assert col1(spark, [" Randomized ", "NON_RANDOMIZED", "non-randomised", None], R.allocation) == \
        ["Randomized", "Unknown", "Non-Randomized", "Unknown"]


def test_flags_and_title(spark):
    assert col1(spark, ["10 mg", "No", None, "TRUE"], lambda c: R.contains_flag(c, R.YES_PATTERN)) == [1, 0, 0, 1]
    assert col1(spark, ["  red plate-economy 1st ", "", None], R.study_type) == ["Red Plate-Economy 1St", None, None]
    assert col1(spark, ["University of X", None, "Pharma"], R.sponsor_class) == ["Academic", "Industry", "Industry"]


def test_arms(spark):
    got = col1(spark, ["[1, 2, 3]", "['A', 'R']", "[None, 3]", "[1, 2", "3 arms", "[]", None], R.count_arm_groups)
    assert got == [3.0, 2.0, 2.0, 1.0, 1.0, 0.0, 1.0]


DATES = {
    # ISO, with what may be missing and what may follow
    "2015": "2015-01-01", "2015-03": "2015-03-01", "2015-3-4 10:00": "2015-03-04", "2015-03-05T10:00": "2015-03-05",
    "2015-13-01": None, "2015-02-30": None,
    # a month word, and the words around it
    "March 1995": "1995-03-01", "March 5, 1995": "1995-03-05", "Mar-2015": "2015-03-01", "15 march 2015": "2015-03-15",
    "Tuesday, 4 Sept 2012 at 10:30": "2012-09-04", "Completed: May 7th, 1999 (actual)": "1999-05-07",
    "3 Mar 15": "2015-03-03", "3 Mar 98": "1998-03-03", "March 3": "1900-03-03", "Mar 98": "1998-03-01",
    "marching on 2001": "2001-01-01", "Feb 30, 2001": None,
    # numbers alone
    "03/15/2015": "2015-03-15", "15/03/2015": "2015-03-15", "2015/03/15": "2015-03-15", "12.11.2010": "2010-12-11",
    "7/4/98": "1998-07-04", "03/2015": "2015-03-01", "15 2015": "2015-01-15", "20150315": "2015-03-15",
    "20150315101112": "2015-03-15", "99/99/9999": None, "201503": None, "x1995": "1995-01-01", "about 1996?": "1996-01-01",
    # none
    "unknown": None, "": None, "Tuesday": None, "10:30": None, "7": None, "123456789012345678901234567890": None,
}


def test_dates(spark):
    got = col1(spark, [*DATES, None], R.parse_date_any)
    assert dict(zip(DATES, [str(x) if x else None for x in got], strict=False)) == DATES and got[-1] is None
