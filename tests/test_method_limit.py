"""Wide projections are compiled, and stripping is exact without the pattern."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tallyline.functions.text import strip
from tallyline.plans import registry
from tallyline.session import METHOD_LIMIT


def test_queries_keep_methods_compilable(spark):
    before = spark.conf.get(METHOD_LIMIT, None)
    asked = lambda: registry.QUERIES["limit_probe"](spark, "").first()[0]
    registry.query("limit_probe")(lambda s, d: s.range(1).select(F.lit(s.conf.get(METHOD_LIMIT))))
    try:
        spark.conf.unset(METHOD_LIMIT)
        assert asked() == "8000"
        spark.conf.set(METHOD_LIMIT, "9000")  # a limit that was given stays
        assert asked() == "9000"
    finally:
        registry.QUERIES.pop("limit_probe")
        spark.conf.unset(METHOD_LIMIT)
        if before is not None:
            spark.conf.set(METHOD_LIMIT, before)


def test_strip_equals_its_pattern(spark):
    odd = ["".join(x) for n in range(4) for x in itertools.product([" ", "\t", "a", "\u0085", "\n", "\u2028", "\u00a0"], repeat=n)]
    rows = spark.createDataFrame([(x,) for x in [*odd, "a b  ", " \r\n b \x0b\f", "a \u2029", None]], "c string")
    want = F.regexp_replace("c", r"^\s+|\s+$", "")
    assert rows.where(~strip(F.col("c")).eqNullSafe(want)).count() == 0
    # and the pattern is left to texts that need it
    assert "btrim" in str(strip(F.col("c")))
