"""Text cleaning, duration redaction and sentence/token splitting (T2x-T4x).

Everything but HTML entity decoding is a native ``regexp_replace`` chain.
Entity decoding needs the full HTML5 entity table, which Spark lacks; it is
an Arrow-batched ``pandas_udf`` over the standard library's ``html.unescape``
and it returns rows without ``&`` untouched.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import _c, py_strip

# fixed values ---------------------------------------------------------------
TAG = r"<[^>]+>"
# horizontal whitespace: space, tab, CR, form feed, vertical tab (\x0B, not \v,
# which is a line-break class in Java regex)
HSPACE = "[ \\t\\r\\f\\x0B]+"
NEWLINES_3 = r"\n{3,}"
BULLET = "•"
NBSP = " "
# duration phrases, case-insensitive, tried left to right
DURATION = (
    r"(?i)\b("
    r"(?:\d+(?:\.\d+)?)\s*(?:year|month|week|day)s?"
    r"|(?:\d+\s*-\s*\d+)\s*(?:year|month|week|day)s?"
    r"|(?:up\s+to|at\s+least|approximately)\s+\d+(?:\.\d+)?\s*(?:year|month|week|day)s?"
    r")\b"
)
DURATION_TOKEN = " <DURATION> "
SENTENCE_SEP = r"\. "


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


def html_unescape(c) -> Column:
    """Only texts holding ``&`` cross into Python: others are sent as null
    (a few bytes in the Arrow batch) and come back unchanged via coalesce."""
    s = _c(c)
    return F.coalesce(_unescape(F.when(s.contains("&"), s)), s)


def clean_text(c, redact: bool = False, decode_entities: bool = True) -> Column:
    """Decode entities, drop tags, bullets to ``*``, NBSP to space, collapse
    horizontal blanks, strip, squash 3+ newlines; null/blank -> ''."""
    s = _c(c)
    t = html_unescape(s) if decode_entities else s
    t = F.regexp_replace(t, TAG, " ")
    t = F.replace(t, F.lit(BULLET), F.lit("*"))
    t = F.replace(t, F.lit(NBSP), F.lit(" "))
    t = py_strip(F.regexp_replace(t, HSPACE, " "))
    t = F.regexp_replace(t, NEWLINES_3, "\n\n")
    if redact:
        t = redact_durations(t)
    return F.when(s.isNull() | (py_strip(s) == ""), F.lit("")).otherwise(t)


def redact_durations(c) -> Column:
    t = F.regexp_replace(_c(c), DURATION, DURATION_TOKEN)
    return py_strip(F.regexp_replace(t, HSPACE, " "))


def sentences(c) -> Column:
    """Split on the literal ``". "`` (the whole text, every sentence)."""
    return F.split(F.coalesce(_c(c), F.lit("")), SENTENCE_SEP)


def tokens(c) -> Column:
    """Whitespace tokens without empties (Python ``str.split()``)."""
    return F.filter(F.split(_c(c), r"\s+"), lambda x: x != "")
