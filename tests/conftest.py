import datetime as dt

import numpy as np
import pytest

from barloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BAR_SCHEMA = ("datetime timestamp_ntz, vt_symbol string, open double, high double, low double, close double, "
              "volume double, turnover double, vwap double")


def make_bars(spark, sizes: dict[str, int], seed: int = 42):
    """Random-walk bars per symbol, with ties, from 2023-01-01."""
    rng = np.random.default_rng(seed)
    rows = []
    for symbol, days in sizes.items():
        price = 50.0
        for d in range(days):
            o = round(price, 1)
            price = max(5.0, price * (1 + rng.normal(0, 0.03)))
            c = round(price, 1)
            h, l = max(o, c) + round(rng.random(), 1), min(o, c) - round(rng.random(), 1)
            v = float(rng.integers(1, 9) * 100)
            rows.append((dt.datetime(2023, 1, 1) + dt.timedelta(days=d), symbol, o, h, l, c, v, v * c, c))
    return spark.createDataFrame(rows, BAR_SCHEMA)


@pytest.fixture(scope="session")
def bars(spark):
    df = make_bars(spark, {"A": 180, "B": 60, "C": 45, "D": 45}).cache()
    df.count()
    return df


def same(a, b, digits=8):
    """Equal rows, doubles to ``digits`` significant digits, any row order."""
    def norm(df):
        out = []
        for row in df.collect():
            out.append(tuple(
                "nan" if isinstance(v, float) and v != v else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
                for v in row))
        return sorted(out)
    left, right = norm(a), norm(b.select(*a.columns))
    assert len(left) == len(right)
    different = [(x, y) for x, y in zip(left, right) if x != y]
    assert not different, different[:3]
