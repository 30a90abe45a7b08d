"""Numbers with decimals in a candidate's line, against printf."""

import pytest
from pyspark.sql import functions as F

from tubula.functions import display

VALUES = [0.125, 1.005, 3.025, 71.25, 71.35, 0.5, 2.5, 1e-9, -0.04, -0.0, 123456.789, 1.15, 99.95, 0.675, float("nan"), float("inf"), float("-inf")]


@pytest.mark.parametrize(("digits", "width"), [(1, 5), (2, 0), (2, 5), (4, 8)])
def test_decimals_are_those_of_printf(spark, digits, width):
    rows = spark.createDataFrame([(v,) for v in VALUES], "v double").select("v", display.decimals(F.col("v"), digits, width).alias("text"))
    assert all(r.text == f"%{width or ''}.{digits}f" % r.v for r in rows.collect())


def test_a_line_rounds_values_and_not_their_digits(spark):
    row = spark.createDataFrame([(71.25, "UNKNOWN", 1, 2, 3, 3.025, 0.965)], "score double, type string, x int, y int, z int, max_br double, max_si double")
    want = "Score: %5.1f | Aneurysm [%s] at (X:%d, Y:%d, Z:%d) | BulgeRatio: %5.2f | ShapeIndex: %.2f" % (71.25, "UNKNOWN", 1, 2, 3, 3.025, 0.965)
    assert display.report(row).first().line == want and "71.2 " in want and " 3.02 " in want
