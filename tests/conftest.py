from __future__ import annotations

import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def spark():
    from chaffsieve.session import local_session

    session = local_session(cores=4, memory="4g", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def same(df, rel) -> None:
    """Columns and rows of a Spark and a DuckDB result are equal, in any order."""
    got, want = df.toPandas(), rel.df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(frame):
        frame = frame[sorted(frame.columns)].astype(object)

        def plain(v):
            v = None if pd.isna(v) else v.item() if hasattr(v, "item") else v
            # Pandas turns whole numbers with nulls into floats.
            return int(v) if isinstance(v, float) and v.is_integer() else v

        return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))

    assert rows(got) == rows(want)
