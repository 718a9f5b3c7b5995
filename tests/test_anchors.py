"""Chart anchors on literal cases."""

import pytest
from pyspark.sql import functions as F

from docengine.operators import anchors as A


def run(spark, make, md, ids, hints):
    rows = spark.createDataFrame([(md, ids, hints)], "md string, ids array<string>, hints map<string,string>")
    return rows.select(make(F.col("md"), A.charts(F.col("ids"), F.col("hints"))).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "md, ids, hints, out",
    [
        ("First paragraph.\n\nSolar power grows fast.\n\n# Head\n\nWind is next.", ["w", "s"], {"w": "wind is next", "s": "Solar power"}, "First paragraph.\n\nSolar power grows fast.\n\n[Chart: s]\n\n# Head\n\nWind is next.\n\n[Chart: w]\n"),
        ("First paragraph.\n\nSolar power.\n\n# Head\n\nWind is next.", ["w", "s"], {"w": "Wind is next", "s": "Solar power"}, "First paragraph.\n\nSolar power.\n\n[Chart: s]\n\n# Head\n\nWind is next.\n\n[Chart: w]\n"),
        ("one\n\ntwo [Chart: old]  x", ["c", " ", "d"], {}, "one\n\ntwo x\n\n[Chart: c]\n\n[Chart: d]\n"),
        ("only", ["c"], {}, "only\n\n[Chart: c]\n"),
        ("# only a heading", ["c"], {}, "# only a heading\n\n[Chart: c]\n"),
        ("Solar first\n\nother", ["c"], {"c": "Solar"}, "Solar first\n\n[Chart: c]\n\nother\n"),
        ("short\n\ntwo\n\n" + "long " * 30, ["c"], {}, "short\n\ntwo\n\n" + ("long " * 30).strip() + "\n\n[Chart: c]\n"),
        ("", ["c", "d"], {}, "[Chart: c]\n\n[Chart: d]\n"),
        (None, [], None, ""),
        ("text [Chart: x]", None, None, "text\n"),
    ],
)
def test_place(spark, md, ids, hints, out):
    assert run(spark, A.place_anchors, md, ids, hints) == out


def test_ensure_and_tail(spark):
    tail = "Solar power.\n\nWind.\n\n[Chart: a]\n[Chart: b]"
    hints = {"a": "Solar power", "b": "Wind"}
    assert run(spark, A.spread_tail, tail, ["a", "b"], hints) == "Solar power.\n[Chart: a]\n\nWind.\n[Chart: b]\n"
    assert run(spark, A.spread_tail, "x\n\n[Chart: a]", ["a"], {}) == "x\n\n[Chart: a]"  # one is no pile
    assert run(spark, A.spread_tail, "x\n\nWind", ["b"], hints) == "x\n\nWind\n[Chart: b]\n"
    assert run(spark, A.spread_tail, "x\r\ny", [], {}) == "x\ny"
    assert run(spark, A.ensure_anchors, "x\n\n[Chart: a]", ["a", "b"], {}) == "x\n[Chart: b]\n\n[Chart: a]\n"
    assert run(spark, A.ensure_anchors, "x [Chart: a]", ["a"], {}) == "x [Chart: a]"
    assert run(spark, A.ensure_anchors, None, ["a", "b"], {}) == "[Chart: a]\n[Chart: b]\n"
    assert run(spark, lambda md, _: A.strip_anchors(md), "a  [Chart: x] b\n\n\n\nc", [], {}) == "a b\n\nc\n"
