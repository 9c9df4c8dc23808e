import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from spanforge.session import local_session

    session = local_session(4, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    return con


def rows(frame):
    """Rows with columns in order of name, numbers rounded, sorted."""

    def plain(v):
        if v is None or v != v:
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        return repr(round(float(v), 6)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    frame = frame[sorted(frame.columns)].astype(object).where(lambda x: x.notna(), None)
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))
