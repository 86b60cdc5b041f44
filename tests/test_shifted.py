"""Queries against their SQL on tables whose keys or values the small tables don't have."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.plans import catalog

from .sqlcheck import connection, differences

SF = "/root/testdata/sf0.001"

#: An embedding of which two vertices are as far from a segment up to the last bit.
CLOSE = [-0.005, -0.175, -0.055, -0.015, 0.035, 0.105, 0.205, 0.015, -0.255, -0.005, -0.155, 0.145, 0.145, 0.055, 0.055, -0.095, -0.105, -0.115, -0.215, -0.115, -0.055, -0.065, 0.005, 0.115, 0.005, -0.005, -0.025, -0.075, -0.095, 0.165, -0.015, -0.115, 0.165, -0.235, -0.035, -0.245, -0.065, -0.025, -0.075, 0.075, -0.105, -0.195, -0.005, -0.185, 0.225, 0.085, 0.145, -0.015]


def _differences(spark, folder, name):
    return differences(catalog.queries()[name](spark, str(folder)), catalog.oracle_sql()[name], connection(str(folder)))


@pytest.mark.parametrize("name", ["j07_overlay", "t04_t11_merged_after_import"])
def test_parts_with_the_numbers_of_suppliers(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + 999995 AS p_partkey) FROM '{SF}/part.parquet') TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT * FROM '{SF}/supplier.parquet') TO '{tmp_path}/supplier.parquet'")
    assert not _differences(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["f55_kept_vertices", "f57_kept_vertices"])
def test_vertices_that_are_nearly_as_far(spark, tmp_path, name):
    duckdb.connect().execute(f"COPY (SELECT 2833 AS vec_id, CAST({CLOSE} AS FLOAT[]) AS embedding) TO '{tmp_path}/embeddings.parquet'")
    assert not _differences(spark, tmp_path, name)


def test_measures_work_a_ring_out_once(spark):
    ring = F.reverse(F.col("marker"))
    assert [str(measure(ring)).count("marker") for measure in (G.area, G.bounds)] == [1, 1]
    found = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 3D)) AS marker UNION ALL SELECT null")
    assert {(r.a, tuple(r.b)) for r in found.select(G.area(ring).alias("a"), G.bounds(ring).alias("b")).collect()} == {(6.0, (0.0, 0.0, 4.0, 3.0)), (None, (None,) * 4)}
