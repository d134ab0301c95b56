import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyspark.model import ColumnMeta, Dataset
from tallyspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def dataset(spark):
    """``dataset("date region revenue", rows)``: text dates, numbers as measures."""

    def make(names, rows, measures=("revenue",), ignored=()):
        names = names.split()
        kinds = []
        for i, n in enumerate(names):
            sample = next((r[i] for r in rows if r[i] is not None), "")
            kinds.append(f"{n} {'double' if isinstance(sample, float) else 'long' if isinstance(sample, int) else 'string'}")
        df = spark.createDataFrame(rows, ", ".join(kinds))
        columns = [ColumnMeta(n, "date" if n == "date" else "measure" if n in measures else "ignored" if n in ignored
                              else "dimension", "currency" if n in measures else None) for n in names]
        return Dataset.open(df, columns)

    return make


@pytest.fixture
def series(spark):
    """A monthly series from its values, starting in a given month."""

    def make(values, start=dt.date(2022, 1, 1), name="m"):
        rows = []
        for i, v in enumerate(values):
            y, m = divmod(start.year * 12 + start.month - 1 + i, 12)
            rows.append((name, dt.date(y, m + 1, 1), float(v)))
        return spark.createDataFrame(rows, "measure string, period_key date, value double")

    return make


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]
