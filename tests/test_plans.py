"""Every registered query with SQL gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest

from agora import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    def plain(v):
        return v if isinstance(v, bool) or v is None else round(float(v), 6) if isinstance(v, (int, float)) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    found = duck.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, found.fetchall())


def test_containment_claims_no_intervals_or_findings():
    assert not {"JN-23", "AG-26", "RT-09"} & set(plans.registry.COVERS["containment_proof_audit"])
