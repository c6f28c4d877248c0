from __future__ import annotations

import random

from creditloom.functions import percent
from tests.conftest import rows


def test_percent_rounds_the_double_itself(spark):
    """As C and Python print it: 38.25 is a tie and goes to even, 58.15 lies below its name."""
    draw = random.Random(7)
    shares = [0.3825, 0.5815, 0.0, 1.0, 0.0005, -0.0004, 2.5e-4, *[draw.randrange(20000) / 20000 for _ in range(3000)]]
    shares += [draw.uniform(-2, 2) for _ in range(1000)]
    df = spark.createDataFrame([(s,) for s in shares], "share double")
    found = rows(df.select("share", percent("share").alias("shown"), percent("share", 2).alias("finer")))
    assert [r[1] for r in found] == [f"{r[0] * 100:.1f}%" for r in found]
    assert [r[2] for r in found] == [f"{r[0] * 100:.2f}%" for r in found]
    assert rows(spark.sql("SELECT CAST(NULL AS DOUBLE) AS share").select(percent("share"))) == [("n/a",)]
