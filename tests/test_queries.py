import pytest
from conftest import DATA, rows

from spanforge.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_every_relational_query_has_sql():
    assert set(QUERIES) - set(SQL) == {"m_dp_segment", "m_documents"}
    assert len(QUERIES) >= 113


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_greedy_gap_against_loop(spark):
    found = QUERIES["w_greedy_gap"](spark, f"{DATA}/sf0.001").toPandas()
    from spanforge.sources.proxies import frames

    wanted = set()
    for e, g in frames(spark, f"{DATA}/sf0.001").toPandas().sort_values("frame_index").groupby("episode_index"):
        last = None
        for i, t in zip(g["frame_index"], g["ts"], strict=True):
            if last is None or (t - last).total_seconds() >= 86400:
                wanted.add((e, i))
                last = t
    assert set(zip(found["episode_index"], found["frame_index"], strict=True)) == wanted


def test_extract_json():
    from spanforge.functions.jsonx import first_object

    assert first_object('x {"a": "{"} y') == '{"a": "{"}'
    assert first_object('say ```json\n{"b": 1}\n``` {"c": 2}') == '{"b": 1}'
    assert first_object("[1]") is None and first_object(None) is None and first_object("{broken") is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
