import numpy as np
import pandas as pd
import pytest

from candlewick.operators.quantreg import fit_lines

LEVELS = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    n = 1500
    a, b, ticker = draw.normal(5, 2, n), draw.exponential(100, n), draw.choice(["A", "B", "C"], n)
    y = 1 + 2 * a - 0.01 * b + (ticker == "B") * 3 + (1 + 0.3 * np.abs(a)) * draw.standard_t(3, n)
    return pd.DataFrame({"a": a, "b": b, "ticker": ticker, "y": y, "times": draw.integers(1, 6, n)})


def loss(rows, line, level, times):
    x = np.column_stack([np.ones(len(rows)), rows.a, rows.b, rows.ticker == "B", rows.ticker == "C"]).astype(float)
    r = rows.y.to_numpy() - x @ np.array(line)
    return (times * np.maximum(level * r, (level - 1) * r)).sum(), x


@pytest.mark.parametrize("weighted", [False, True])
def test_no_line_nearby_is_better_and_shares_are_right(spark, rows, weighted):
    df = spark.createDataFrame(rows).repartition(5)
    model = fit_lines(df, ["a", "b"], "y", ["A", "B", "C"], "times" if weighted else None)
    times = rows.times.to_numpy() if weighted else np.ones(len(rows))
    draw = np.random.default_rng(0)
    for q, level in LEVELS.items():
        line = np.array(model.coefficients[q])
        own, x = loss(rows, line, level, times)
        for _ in range(300):  # the loss is convex: a better line anywhere would show nearby
            turn = draw.normal(size=5) / np.maximum(x.std(0), 0.5) * draw.choice([1e-3, 1e-2, 1e-1])
            assert loss(rows, line + turn, level, times)[0] > own * (1 - 2e-4)
        below = times[rows.y.to_numpy() < x @ line - 1e-9].sum() / times.sum()
        up_to = times[rows.y.to_numpy() <= x @ line + 1e-9].sum() / times.sum()
        assert below - times.max() / times.sum() <= level <= up_to + times.max() / times.sum()
    assert model.losses[0] > 1.2 * model.losses[-1] >= 1.2 * min(model.losses) * (1 - 1e-12)


def test_predictions_unknown_tickers_and_no_rows(spark, rows):
    df = spark.createDataFrame(rows.head(400))
    model = fit_lines(df, ["a", "b"], "y", ["A", "B", "C"])
    new = spark.createDataFrame([(5.0, 100.0, "A"), (5.0, 100.0, "Z"), (5.0, 100.0, "B")], "a double, b double, ticker string")
    one, other, b = model.predict(new, ["ticker"]).collect()
    assert one[1:] == other[1:] and one.q10 < one.q50 < one.q90
    assert b.q50 - one.q50 == pytest.approx(model.coefficients["q50"][3])
    with pytest.raises(ValueError, match="no rows"):
        fit_lines(df.limit(0), ["a", "b"], "y", ["A", "B", "C"])
