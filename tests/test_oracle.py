"""Every registered query against its DuckDB SQL on the smallest driver tables."""

import math

import duckdb
import pytest

from __spark_entry__ import entry
from scour.plans.oracle import ORACLE
from scour.plans.registry import QUERIES
from scour.sources.tables import TABLES
from tests.conftest import SF_SMALL


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


#: Their hits may miss neighbours, which no SQL foretells; their recall has an oracle.
APPROXIMATE = {"knn_probe", "knn_graph"}


def test_every_exact_query_has_an_oracle():
    assert set(QUERIES) - APPROXIMATE == set(ORACLE) and APPROXIMATE < set(QUERIES)


@pytest.mark.parametrize("name", sorted(APPROXIMATE))
def test_approximate_hits_are_true_and_their_recall_is_told(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    exact = duck.sql(ORACLE["knn_batch"]).df()
    true = {(q, v): d for q, v, d in exact[["query_id", "vec_id", "dist2"]].itertuples(index=False)}
    for query, hits in got.groupby("query_id"):
        hits = hits.sort_values("rank")
        assert hits["dist2"].is_monotonic_increasing and hits["vec_id"].is_unique and len(hits) == 5
        found = [(query, v) in true for v in hits["vec_id"]]
        assert sum(found) / 5 == hits["recall"].iloc[0] and hits["recall"].nunique() == 1
        assert all(abs(true[query, v] - d) < 2e-6 for v, d in zip(hits["vec_id"], hits["dist2"], strict=True)
                   if (query, v) in true)
    assert got["query_id"].nunique() == exact["query_id"].nunique()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - APPROXIMATE))
def test_query_matches_oracle(spark, duck, name):
    got = _rows(QUERIES[name](spark, SF_SMALL).toPandas())
    want = _rows(duck.sql(ORACLE[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_runs(spark):
    df = entry(spark)
    assert set(df.columns) == {"query_id", "status_code", "error", "markdown"}
    assert df.count() >= 0
