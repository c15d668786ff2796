"""Model input rows of plain numbers do not go through text."""

import math

from pyspark.sql import functions as F

from riskgraph.functions import scalar as S
from riskgraph.operators.model import Scorer


def test_plain_numbers_are_not_parsed_and_stay_the_same(spark):
    values = [0.1, -0.0, 1e-310, 1.7976931348623157e308, math.inf, -math.inf, math.nan, None, 123456789.123456789]
    whole = [2**63 - 1, -(2**63), 2**53 + 1, 0, None, 7, 1, 2, 3]
    rows = [(d, n, n and n % 100, None if d is None else str(d), d) for d, n in zip(values, whole)]
    df = spark.createDataFrame(rows, "d double, n long, i int, s string, f float")
    for c, kind in df.dtypes:
        both = df.select(S.number(F.col(c)).alias("a"), S.number(F.col(c), kind=kind).alias("b")).collect()
        assert [(r.a, math.copysign(1, r.a)) for r in both] == [(r.b, math.copysign(1, r.b)) for r in both]
    plan = Scorer(None, ["d", "n", "i", "absent"]).rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan and "try_cast" not in plan
    assert "try_cast" in Scorer(None, ["s"]).rows(df)._jdf.queryExecution().optimizedPlan().toString().lower()
