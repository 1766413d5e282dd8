"""Text cleaning against a plain-Python reading of the rules; path compiler cases."""

import html
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from durata.functions import text as TX
from durata.functions.paths import value_from_paths
from tests.conftest import SF_SMALL

_WS = re.compile(r"[ \t\r\f\v]+")


def py_clean(s, redact=False):
    if not isinstance(s, str) or not s.strip():
        return ""
    s = html.unescape(s)
    s = re.sub(r"<[^>]+>", " ", s).replace("•", "*").replace("\xa0", " ")
    s = _WS.sub(" ", s).strip()
    s = re.sub(r"\n{3,}", "\n\n", s)
    if redact:
        s = re.sub(TX.DURATION, TX.DURATION_TOKEN, s)
        s = _WS.sub(" ", s).strip()
    return s


def test_clean_text_on_pages(spark):
    p = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    t = F.concat("html", F.lit("<p>for 12-24 months, up to 6 years &amp; 3.5 days•</p>\n\n\n\nx"))
    rows = p.select(t.alias("t"), TX.clean_text(t).alias("c"), TX.clean_text(t, redact=True).alias("r")).collect()
    for r in rows:
        assert r.c == py_clean(r.t)
        assert r.r == py_clean(r.t, True)


def test_redaction_fixture(spark):
    df = spark.createDataFrame([("for 12-24 months, up to 6 years",), (None,), ("  ",)], "t string")
    got = [r[0] for r in df.select(TX.clean_text("t", redact=True)).collect()]
    assert got == ["for <DURATION> , <DURATION>", "", ""]


def test_paths(spark):
    schema = T.StructType([T.StructField("a", T.StructType([
        T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.StringType())]))),
        T.StructField("d", T.StringType()), T.StructField("e", T.StringType())]))])
    df = spark.createDataFrame([({"b": [{"c": "x"}, {"c": "y"}], "d": "2015-01-01", "e": "2015-01"},)], schema)
    specs = {"first": "a.b[0].c", "last": "a.b[-1].c", "oob": "a.b[5].c", "neg_oob": "a.b[-3].c",
             "through": "a.b.c", "missing": "a.zz", "idx_on_scalar": "a.d[0]", "diff": "a.d | a.d",
             "partial": "a.e | a.d", "three": "a.d | a.d | a.d"}
    r = df.select(*[value_from_paths(df.schema, v).alias(k) for k, v in specs.items()]).first().asDict()
    assert r == {"first": "x", "last": "y", "oob": None, "neg_oob": None, "through": None, "missing": None,
                 "idx_on_scalar": None, "diff": 0, "partial": None, "three": None}
