import decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions.ratio import pct_tenths, quot_hundredths, scaled_round, to_decimal


def half_up(num, den, digits):
    q = decimal.Decimal(num) / decimal.Decimal(den)
    return q.quantize(decimal.Decimal(1).scaleb(-digits), rounding=decimal.ROUND_HALF_UP)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(0, 10**9)), min_size=1, max_size=40))
def test_exact_rounding_matches_decimal(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    got = df.select("n", "d", to_decimal(pct_tenths(F.col("n"), F.col("d")), 1).alias("p"),
                    to_decimal(quot_hundredths(F.col("n"), F.col("d")), 2).alias("q")).collect()
    for r in got:
        if r["d"] == 0:
            assert r["p"] == 0 and r["q"] == 0
        else:
            assert r["p"] == half_up(100 * r["n"], r["d"], 1)
            assert r["q"] == half_up(r["n"], r["d"], 2)


def test_halves_round_away_from_zero(spark):
    row = spark.range(1).select(
        to_decimal(pct_tenths(F.lit(1), F.lit(8)), 1).alias("a"),      # 12.5
        to_decimal(pct_tenths(F.lit(1), F.lit(16)), 1).alias("b"),     # 6.25 -> 6.3
        scaled_round(F.lit(1), F.lit(2), 1).alias("c"),                # 0.5 -> 1
        to_decimal(quot_hundredths(F.lit(1), F.lit(8)), 2).alias("d"),  # 0.125 -> 0.13
    ).first()
    assert str(row["a"]) == "12.5" and str(row["b"]) == "6.3" and row["c"] == 1 and str(row["d"]) == "0.13"
