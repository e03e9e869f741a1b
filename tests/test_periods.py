import datetime as dt
import random

import pytest

from foliograph.functions import months
from foliograph.operators import periods
from pyspark.sql import functions as F


def brute(rows):
    """Periods and gaps of (key, a, b) rows by marking every integer."""
    out = set()
    for key in {k for k, *_ in rows}:
        marked = sorted({x for k, a, b in rows if k == key and a is not None and b is not None for x in range(a, b + 1)})
        runs = []
        for x in marked:
            if runs and runs[-1][1] == x - 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        out |= {(key, "period", a, b) for a, b in runs} | {(key, "gap", p[1] + 1, n[0] - 1) for p, n in zip(runs, runs[1:])}
    return out


def found(spark, rows, level=periods.MAX_LEVEL):
    frame = spark.createDataFrame(rows, "k string, a int, b int")
    both = periods.with_gaps(periods.continuous(frame, "k", "a", "b", level), "k", "a", "b")
    return [tuple(r) for r in both.collect()]


@pytest.mark.parametrize("level", [3, 9])
def test_against_marking_every_integer(spark, level):
    rng = random.Random(level)
    rows = []
    for _ in range(300):
        a = rng.randrange(0, 400)
        rows.append((rng.choice("xyz"), a, a + rng.choice([0, 0, 1, 3, 7, 40, -1])))
    rows += [("x", 5, 5)] * 50 + [("y", None, 3), ("y", 3, None)]
    result = found(spark, rows, level)
    assert len(result) == len(set(result))
    assert set(result) == brute([r for r in rows if None in r or r[1] <= r[2]])


def test_nulls_empty_and_one_hot_key(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, 2)]) == []
    hot = [("hot", i % 90, i % 90 + i % 3) for i in range(5000)]
    assert set(found(spark, hot)) == brute(hot)


@pytest.mark.parametrize(
    "typed, start, end",
    [
        ("2010", "2010-01", "2010-12"), ("02/2014", "2014-02", "2014-02"), ("12/08", "2008-12", "2008-12"), ("12/40", "1940-12", "1940-12"), ("2010-05-31", "2010-05", "2010-05"), ("31.02.2010", None, None),
        ("13/2010", None, None), ("Sept. 2012", "2012-09", "2012-09"), (" May, 2010 ", "2010-05", "2010-05"), ("Oct-08", "2008-10", "2008-10"), ("Nov '99", "1999-11", "1999-11"), ("octubre de 2011", "2011-10", "2011-10"),
        ("28 February 2018", "2018-02", "2018-02"), ("heute", "2024-03", "2024-03"), ("till date", "2024-03", "2024-03"), ("circa 2010", None, None), ("??/2018", None, None), ("20I9", None, None), ("", None, None), (None, None, None), ("März 1998", "1998-03", "1998-03"),
    ],
)
def test_typed_dates(spark, typed, start, end):
    frame = spark.createDataFrame([(typed, dt.datetime(2024, 3, 5))], "v string, t timestamp")
    today = months.month_of(F.col("t"))
    row = frame.select(*[months.as_text(months.month_number(F.col("v"), alone, today)).alias(f"c{alone}") for alone in (1, 12)]).first()
    assert (row[0], row[1]) == (start, end)
