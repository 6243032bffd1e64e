"""All queries on tables without rows."""

import glob
import os

import pyarrow.parquet as pq
import pytest

from loomlog.llm import queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for f in glob.glob(f"{D}/*.parquet"):
        rows = pq.read_table(f)
        pq.write_table(rows if os.path.basename(f) in ("mix_targets.parquet", "split_limits.parquet") else rows.slice(0, 0), f"{folder}/{os.path.basename(f)}")
    return folder


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    rows = queries.QUERIES[name](spark, empty).collect()
    assert all(r.used_tokens == 0 and r.actual_share == 0 for r in rows) if name == "p9_shares" else rows == []
