from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loamworks.session import session

    shared = tmp_path_factory.mktemp("shared")
    own = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(shared / "warehouse"), spark__driver__memory="3g")
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tables(small):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{small}/{name}'")
    return con


def same_rows(spark_df, duck_relation) -> None:
    """Equal as bags of rows, columns by name."""
    a, b = spark_df.toPandas(), duck_relation.df()
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    a, b = (sorted((tuple(None if v is None or v != v else v for v in r) for r in x[names].astype(object).values.tolist()), key=repr) for x in (a, b))
    assert a == b
