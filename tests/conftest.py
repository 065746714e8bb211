import datetime as dt
import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from movewatch import schemas  # noqa: E402
from movewatch.session import local_session  # noqa: E402

UTC = dt.timezone.utc
DAY = 86_400_000
EVENT_DAY = dt.datetime(2026, 5, 15, 20, tzinfo=UTC)


def ms(when: dt.datetime) -> int:
    return int(when.timestamp() * 1000)


def weekdays(n: int, end: dt.datetime = EVENT_DAY) -> list[int]:
    out, day = [], end
    while len(out) < n:
        if day.weekday() < 5:
            out.append(ms(day))
        day -= dt.timedelta(days=1)
    return out[::-1]


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="12g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


# company: (sector, last close, last volume, return, z, volume ratio, flagged)
SCORED = {
    "AAA": ("S1", 94.0, 3300, -0.060, -3.948130, 3.065015, True),
    "BB1": ("S2", 95.5, 2900, -0.045, -3.405139, 2.727273, True),
    "BB2": ("S2", 95.2, 3000, -0.048, -3.532631, 2.812500, True),
    "BB3": ("S2", 95.8, 2900, -0.042, -3.266656, 2.727273, True),
    "CCC": ("S3", 95.0, 2900, -0.050, -3.611907, 2.727273, True),
    "QUI": ("S4", 101.0, 1000, 0.010, 0.966092, 1.000000, False),
    "VOL": ("S4", 101.0, 4000, 0.010, 0.966092, 3.636364, True),
}


def bar(company, ts, close, volume):
    return (company, ts, close, close, close, close, volume)


def base_closes(n):
    return [100.0 if i % 2 == 0 else 101.0 for i in range(n)]


def fixture_bars():
    days = weekdays(30)
    rows = []
    for company, (_, close, volume, *_rest) in SCORED.items():
        closes = base_closes(29) + [close]
        volumes = [1000] * 29 + [volume]
        rows += [bar(company, t, c, v) for t, c, v in zip(days, closes, volumes)]
    rows.append(bar("AAA", weekdays(31)[0], 500.0, 1000))  # a 31st, older bar
    rows += [bar("FLAT", t, 100.0, 0) for t in days]
    rows += [bar("SHRT", t, c, 1000) for t, c in zip(days[1:], base_closes(29))]
    rows += [bar("NULC", t, None if i == 10 else 100.0, 1000) for i, t in enumerate(days)]
    return rows


@pytest.fixture(scope="session")
def bars(spark):
    return spark.createDataFrame(fixture_bars(), schemas.BAR)


@pytest.fixture(scope="session")
def companies(spark):
    rows = [(c, f"{c.title()} Holdings Inc", v[0]) for c, v in SCORED.items()]
    rows += [("FLAT", "Flat", "S5"), ("SHRT", "Short", "S6"), ("NULC", "Null Close", "S7")]
    rows += [("NOS1", "No Sector One", None), ("NOS2", "No Sector Two", None)]
    return spark.createDataFrame(rows, schemas.COMPANY)


@pytest.fixture(scope="session")
def news(spark):
    stale = ms(dt.datetime.fromtimestamp(weekdays(10)[0] / 1000, UTC).replace(hour=14))
    rows = [
        ("n1", "AAA", "Aaa cuts guidance", "s", "wire", "u1", ms(EVENT_DAY.replace(hour=13, minute=30))),
        ("n2", "BB1", "Bb1 to present at a conference", None, "wire", None, stale),
        ("n3", "AAA", "Aaa answers", None, None, "u3", ms(EVENT_DAY + dt.timedelta(days=2))),
    ]
    return spark.createDataFrame(rows, schemas.NEWS)


@pytest.fixture(scope="session")
def discussion(spark):
    rows = [
        (f"d{i}", "VOL", f"post {i}", "", "board", f"v{i}", ms(EVENT_DAY.replace(hour=10 + i)))
        for i in range(6)
    ]
    return spark.createDataFrame(rows, schemas.DISCUSSION)


def rows_of(df, *cols):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def by_key(df, key):
    return {r[key]: r for r in df.collect()}


def statistics(closes, volumes):
    """Plain (return, z, ratio) of a list of bars in time order."""
    returns = [b / a - 1 for a, b in zip(closes, closes[1:])]
    mean = sum(returns) / len(returns)
    std = math.sqrt(sum((r - mean) ** 2 for r in returns) / len(returns))
    mean_volume = sum(volumes) / len(volumes)
    return returns[-1], (returns[-1] - mean) / std if std else 0.0, volumes[-1] / mean_volume if mean_volume else 0.0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
