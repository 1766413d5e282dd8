"""Per-row feature rules as native Column expressions.

Every function takes Columns (or column names) and returns a Column, so
Catalyst keeps them inside whole-stage codegen.  No Python runs per row.
Missing values are SQL nulls, never NaN.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------

# Phase labels: source spelling (upper-cased) -> label; unmapped -> "Unknown".
PHASE_MAP = {
    "PHASE1": "Phase 1",
    "PHASE2": "Phase 2",
    "PHASE3": "Phase 3",
    "PHASE4": "Phase 4",
    "PHASE1/PHASE2": "Phase 1_2",
    "PHASE2/PHASE3": "Phase 2_3",
    "EARLY PHASE 1": "Phase 1",
}
PHASE_LEVELS = ["Phase 1", "Phase 1_2", "Phase 2", "Phase 2_3", "Phase 3", "Phase 4", "Unknown"]

# Allocation: stripped, upper-cased source -> label; unmapped -> "Unknown".
ALLOCATION_MAP = {
    "RANDOMISED": "Randomized",
    "RANDOMIZED": "Randomized",
    "NON-RANDOMISED": "Non-Randomized",
    "NON-RANDOMIZED": "Non-Randomized",
}

# Masking: first keyword found (case-insensitive) -> level.
MASKING_KEYWORDS = "none|open label|single|double|triple|quadruple"
MASKING_MAP = {
    "none": "None",
    "open label": "None",
    "single": "Single",
    "double": "Double",
    "triple": "Triple",
    "quadruple": "Quadruple",
}
MASKING_LEVELS = ["None", "Single", "Double", "Triple", "Quadruple", "Other", "Unknown"]
BLINDED_LEVELS = ["Single", "Double", "Triple", "Quadruple"]

SPONSOR_ACADEMIC = "univer|hospital|nih|institute"
YES_PATTERN = "yes|true|1"
SAFETY_PATTERN = "true"

POP_ADULT = r"\badult\b"
POP_CHILD = r"\b(?:child|p(?:a|e)diat|peds?)\b"
POP_MIXED = r"\b(?:both|mixed)\b"
POPULATION_LEVELS = ["Adult", "Pediatric", "Mixed", "Unknown"]

# Bullet line and paragraph separators for eligibility criteria.
BULLET_LINE = r"(?md)^[ \t]*[•*\-][ \t]+"
PARAGRAPH_SPLIT = r"\n\s*\n"

# Age strings: first number, first unit.
AGE_NUMBER = r"(\d+\.?\d*)"
AGE_UNIT = r"(year|month|week|day)s?"

DAYS_PER_YEAR = 365.25

# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Characters Python's ``str.strip()`` removes (fixed value: str.isspace set).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    r"""Python ``str.strip()``: trim any whitespace from both ends.  ``btrim``
    touches only the ends (an anchored ``\s+$`` regex rescans every run)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def py_str(c) -> Column:
    """pandas ``astype(str)`` of a string column: null becomes "None"."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def map_values(c, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Dictionary lookup as a literal map; unmapped / null -> ``default``."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.try_element_at(m, _c(c))
    return v if default is None else F.coalesce(v, F.lit(default))


def ordinal(c, levels: Sequence[str]) -> Column:
    """Position (0-based) of a label in an ordered level list; null if absent."""
    arr = F.array(*[F.lit(x) for x in levels])
    p = F.array_position(arr, _c(c))
    return F.when(p > 0, (p - 1).cast("int"))


def contains_flag(c, pattern: str) -> Column:
    """``astype(str).str.contains(pattern, case=False)`` as 0/1 (null -> 0)."""
    return F.coalesce(py_str(c).rlike("(?i)" + pattern), F.lit(False)).cast("int")


def first_token(c, sep: str = "|") -> Column:
    """First element of a split on a literal separator."""
    import re
    return F.get(F.split(_c(c), re.escape(sep)), 0)


# ---------------------------------------------------------------------------
# dates (F1-F3, F30, F32-F34, P7)
# ---------------------------------------------------------------------------

# English month words, in order (fixed values); the first three letters tell
# them apart, and a word may also stop after them.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december")
_MONTH_WORD = r"(?<![a-z])(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + r"|sept)(?![a-z])"
_ISO = r"^\d{4}(-\d{1,2}(-\d{1,2}([T ].*)?)?)?$"
_CLOCK = r"\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?"
#: Where the year is missing, as the default date of the rule says (fixed value).
DEFAULT_YEAR = 1900


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def parse_date_any(c, pivot: int = 76) -> Column:
    """Lenient date, by the shape of the text.

    ISO dates (yyyy, yyyy-MM, yyyy-MM-dd, with or without a time) are cast.
    Of anything else, whatever words surround it, the month word and the
    numbers are read once and told apart by their length and order:

    * with a month word: a number of four digits is the year, the first
      shorter one the day ("March 3, 2015", "3rd of Mar 2015", "Mar-2015");
      of two short ones the second is the year ("3 Mar 15"), a single one is
      the day of ``DEFAULT_YEAR``, or the year if it is above 31;
    * three numbers: year first if it has four digits, else month, day, year,
      and day, month, year where the first is above 12;
    * two numbers, one of four digits: year and month in either order (a
      number above 12 is a day in January);
    * one number: a year of four digits, or yyyyMMdd and what follows it.

    A missing month or day is 1; two-digit years below ``pivot`` are of this
    century.  Times of day are left out.  No date, or an impossible one, is
    null.
    """
    s = py_strip(_c(c).cast("string"))

    def date(y, m, d):
        return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string")).try_cast("date")

    def full_year(y):
        n = y.cast("int")
        return F.when(F.length(y) > 2, n).when(n < pivot, n + 2000).otherwise(n + 1900)

    def worded(x):
        n, m = x["n"], x["m"]
        long = F.get(F.filter(n, lambda v: F.length(v) == 4), 0)
        short = F.filter(n, lambda v: F.length(v) <= 2)
        first, second = F.get(short, 0), F.get(short, 1)
        return (F.when(long.isNotNull(), date(long, m, F.coalesce(first, F.lit("1"))))
                .when(second.isNotNull() & (first.cast("int") > 31), date(full_year(first), m, second))
                .when(second.isNotNull(), date(full_year(second), m, first))
                .when(first.cast("int") > 31, date(full_year(first), m, F.lit(1)))
                .otherwise(date(F.lit(DEFAULT_YEAR), m, F.coalesce(first, F.lit("1")))))

    def numbers(x):
        n = x["n"]
        p, q, r = F.get(n, 0), F.get(n, 1), F.get(n, 2)
        month_year = F.when(p.cast("int") > 12, date(q, F.lit(1), p)).otherwise(date(q, p, F.lit(1)))
        two = F.when(F.length(p) == 4, date(p, q, F.lit(1))).when(F.length(q) == 4, month_year)
        three = (F.when(F.length(p) == 4, date(p, q, r)).when(p.cast("int") > 12, date(full_year(r), q, p))
                 .otherwise(date(full_year(r), p, q)))
        digits = F.substring(p, 1, 4), F.substring(p, 5, 2), F.substring(p, 7, 2)
        one = F.when(F.length(p) == 4, date(p, F.lit(1), F.lit(1))).when(F.length(p).isin(8, 12, 14), date(*digits))
        return F.when(F.size(n) == 1, one).when(F.length(p) > 4, F.when(F.length(p) == 8, date(*digits))).when(
            F.size(n) == 2, two).when(F.size(n) > 2, three)

    low = F.regexp_replace(F.lower(s), _CLOCK, " ")
    found = F.struct(F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]),
                                      F.substring(F.regexp_extract(low, _MONTH_WORD, 1), 1, 3)).alias("m"),
                     F.filter(F.regexp_extract_all(low, F.lit(r"\d+"), F.lit(0)), lambda v: F.length(v) <= 14).alias("n"))
    soup = _let(found, lambda x: F.when(x["m"] > 0, worded(x)).when(F.size(x["n"]) > 0, numbers(x)))
    return F.when(s.rlike(_ISO), s.try_cast("date")).when(s.isNotNull(), soup)


def iso_date_strict(c) -> Column:
    """Date only for full ``yyyy-MM-dd`` (optionally followed by ``T…``)."""
    s = F.substring_index(_c(c).cast("string"), "T", 1)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def day_diff(end, start) -> Column:
    return F.datediff(_c(end), _c(start))


def days_to_years(days, days_per_year: float = DAYS_PER_YEAR) -> Column:
    return _c(days) / F.lit(float(days_per_year))


def epoch_seconds(date_col) -> Column:
    """Seconds since 1970-01-01 of a date (F30, true seconds)."""
    return (F.unix_date(_c(date_col)).cast("long") * F.lit(86400)).cast("double")


def log_days(days) -> Column:
    d = _c(days)
    return F.when(d > 0, F.log(d.cast("double")))


# ---------------------------------------------------------------------------
# counts (F4-F8, F11, F12, F16)
# ---------------------------------------------------------------------------


def list_len(c, is_array: bool = False) -> Column:
    """Array length, or count of non-empty ``|`` parts (no trim)."""
    if is_array:
        return F.when(_c(c).isNotNull(), F.size(_c(c)).cast("long"))
    parts = F.split(_c(c), r"\|")
    return F.size(F.filter(parts, lambda x: x != "")).cast("long")


def count_any(c, is_array: bool = False) -> Column:
    """How many: array length; pipe parts that are not blank, but a single
    all-digit part counts as its value; null stays null (F5)."""
    if is_array:
        return F.when(_c(c).isNotNull(), F.size(_c(c)).cast("long"))
    parts = F.filter(F.split(_c(c), r"\|"), lambda x: py_strip(x) != "")
    first = F.get(parts, 0)
    return (F.when(_c(c).isNull(), F.lit(None).cast("long"))
            .when((F.size(parts) == 1) & first.rlike(r"^[0-9]+$"), first.try_cast("long"))
            .otherwise(F.size(parts).cast("long")))


def complexity_bucket(n) -> Column:
    x = _c(n)
    return F.when(x.isNull(), F.lit(None).cast("string")) \
        .when(x <= 3, "Low").when(x <= 6, "Medium").otherwise("High")


def n_elig_criteria(text) -> Column:
    """Bullet lines, else non-blank paragraphs; blank text -> null."""
    t = _c(text)
    bullets = F.regexp_count(t, F.lit(BULLET_LINE))
    paras = F.size(F.filter(F.split(t, PARAGRAPH_SPLIT), lambda p: py_strip(p) != ""))
    return (F.when(t.isNull() | (py_strip(t) == ""), F.lit(None).cast("double"))
            .when(bullets > 0, bullets.cast("double"))
            .otherwise(paras.cast("double")))


def count_arm_groups(c, is_array: bool = False, default: float | None = 1.0) -> Column:
    """Arms from an array or from a stringified Python list (F8).

    Strings that do not start with ``[`` or do not parse give null, then
    ``default`` (1.0 in the reference, quirk Q10 keeps ``[]`` at 0).
    """
    if is_array:
        n = F.when(_c(c).isNotNull(), F.size(_c(c)).cast("double"))
    else:
        s = _c(c)
        js = F.regexp_replace(s, r"\bNone\b", "null")
        js = F.regexp_replace(js, r"\bTrue\b", "true")
        js = F.regexp_replace(js, r"\bFalse\b", "false")
        arr = F.from_json(js, "array<string>")
        n = F.when(F.ltrim(s).startswith("[") & s.rlike(r"\]\s*$"), F.size(arr).cast("double"))
        n = F.when(n >= 0, n)
    return n if default is None else F.coalesce(n, F.lit(float(default)))


def count_sites(sites) -> Column:
    return F.coalesce(F.size(_c(sites)), F.lit(0)).cast("long")


def count_unique_countries(sites, field: str = "country") -> Column:
    arr = _c(sites)[field]
    kept = F.filter(arr, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.size(F.array_distinct(kept)), F.lit(0)).cast("long")


# ---------------------------------------------------------------------------
# categories and flags
# ---------------------------------------------------------------------------


def phase_label(c) -> Column:
    return map_values(F.upper(F.coalesce(_c(c), F.lit(""))), PHASE_MAP, "Unknown")


def sponsor_class(c) -> Column:
    hit = F.coalesce(_c(c).rlike("(?i)" + SPONSOR_ACADEMIC), F.lit(False))
    return F.when(hit, "Academic").otherwise("Industry")


def masking_level(c, column_present: bool = True) -> Column:
    """Leftmost keyword -> level, else Other; null reads as "None" (quirk Q1)."""
    if not column_present:
        return F.lit("Unknown")
    kw = F.lower(F.regexp_extract(py_str(c), "(?i)(" + MASKING_KEYWORDS + ")", 1))
    return map_values(kw, MASKING_MAP, "Other")


def masking_flag(level) -> Column:
    return F.coalesce(_c(level).isin(*BLINDED_LEVELS), F.lit(False)).cast("int")


def placebo_flag(c, column_present: bool = True) -> Column:
    if not column_present:
        return F.lit(None).cast("int")
    return contains_flag(c, YES_PATTERN)


def active_prob(placebo, arms) -> Column:
    """1 - placebo/arms; arms 0 -> null; any null -> 1.0."""
    p = _c(placebo).cast("double")
    a = F.nullif(_c(arms).cast("double"), F.lit(0.0))
    return F.coalesce(F.lit(1.0) - F.try_divide(p, a), F.lit(1.0))


def cohort_design(c) -> Column:
    s = F.lower(py_str(c))
    return F.when(s.contains("seq"), "Sequential").when(s.contains("par"), "Parallel").otherwise("Other")


def py_title(c) -> Column:
    """Python ``str.title()``: upper after any non-letter, lower otherwise.

    Text made of letters and blanks only takes native ``initcap`` (identical
    there); anything else goes through the per-character rule."""
    return F.when(_c(c).rlike(r"^[\p{L}\s]*$"), F.initcap(_c(c))).otherwise(_title_chars(c))


def _title_chars(c) -> Column:
    chars = F.split(_c(c), "")
    out = F.transform(
        chars,
        lambda ch, i: F.when(
            (i == 0) | ~F.get(chars, i - 1).rlike(r"^\p{L}$"), F.upper(ch)
        ).otherwise(F.lower(ch)),
    )
    return F.when(_c(c).isNotNull(), F.array_join(out, ""))


def study_type(c) -> Column:
    """strip + title-case, '' -> null; null stays null (documented fix Q2)."""
    t = py_title(py_strip(c))
    return F.when(t != "", t)


AGE_DIVISOR = {"year": 1.0, "month": 12.0, "week": 52.0, "day": 365.0}


def age_to_years(c) -> Column:
    """First number and first unit; month/12, week/52, day/365, no unit ->
    years; blank or ``n/a...`` -> null.  The stripped text is referenced
    three times only, which keeps the generated code small."""
    s = F.lower(py_strip(c))
    num = F.regexp_extract(s, AGE_NUMBER, 1)
    unit = F.regexp_extract(s, "(?i)" + AGE_UNIT, 1)
    div = F.coalesce(map_values(unit, {k: str(v) for k, v in AGE_DIVISOR.items()}).cast("double"), F.lit(1.0))
    return F.when(~s.startswith("n/a"), F.nullif(num, F.lit("")).try_cast("double") / div)


def age_window(age_min, age_max):
    """0 -> null, swap when both present and min > max; returns (min, max, range)."""
    lo0 = F.nullif(_c(age_min), F.lit(0.0))
    hi0 = F.nullif(_c(age_max), F.lit(0.0))
    swap = lo0.isNotNull() & hi0.isNotNull() & (lo0 > hi0)
    lo = F.when(swap, hi0).otherwise(lo0)
    hi = F.when(swap, lo0).otherwise(hi0)
    return lo, hi, hi - lo


def population_class(text, age_min, age_max, is_array: bool = False) -> Column:
    """Keyword rules (mixed > adult > child) with an age fallback."""
    t = F.array_join(_c(text), " ") if is_array else _c(text)
    s = F.lower(py_str(t))
    adult = s.rlike(POP_ADULT)
    child = s.rlike(POP_CHILD)
    mixed = s.rlike(POP_MIXED) | (adult & child)
    lo, hi = _c(age_min), _c(age_max)
    return (F.when(mixed, "Mixed").when(adult, "Adult").when(child, "Pediatric")
            .when(lo.isNotNull() & hi.isNotNull() & (lo < 18) & (hi >= 18), "Mixed")
            .when(lo.isNotNull() & (lo >= 18), "Adult")
            .when(hi.isNotNull() & (hi < 18), "Pediatric")
            .otherwise("Unknown"))


def allocation(c) -> Column:
    return map_values(F.upper(py_strip(py_str(c))), ALLOCATION_MAP, "Unknown")


def randomized_flag(alloc) -> Column:
    return (_c(alloc) == "Randomized").cast("int")


def patients_per_site(patients, sites) -> Column:
    return F.try_divide(_c(patients).cast("double"), F.nullif(_c(sites).cast("double"), F.lit(0.0)))


def global_trial(country_n) -> Column:
    return F.when(_c(country_n) > 1, "Global").otherwise("Single")


def flag01(c) -> Column:
    """Binary flag with null -> 0."""
    return F.coalesce(_c(c).cast("int"), F.lit(0))


def yes_no(c) -> Column:
    """0/1 -> No/Yes (F31); other values -> null."""
    x = _c(c).cast("double")
    return F.when(x == 1, "Yes").when(x == 0, "No")


# ---------------------------------------------------------------------------
# identifiers
# ---------------------------------------------------------------------------

NCT_IN_TEXT = r"(NCT[0-9]{8})"
NCT_FULL = r"^NCT[0-9]{8,10}$"


def normalise_id(c) -> Column:
    """string, strip, upper; null stays null (fix of quirk Q3)."""
    return F.upper(py_strip(_c(c).cast("string")))


def id_from_text(c) -> Column:
    return F.nullif(F.upper(F.regexp_extract(_c(c).cast("string"), NCT_IN_TEXT, 1)), F.lit(""))
