"""Registered queries against the SQL that states their rows, one or two per section, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from beamfold.plans import load_catalog

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
CHECKED = (
    "A1_read_recordings", "A1_rejects", "A3_bad_values", "A9_write_manifest", "A12_replay_stream", "B6_check_record_contract", "B14_select_record",
    "C9_measure_ascans", "C9_measure_recordings", "C10_measure_batches", "D5_to_xyz",
    "E4_rejects", "E12_line_sequence", "F6_raster_frames_by_id", "G3_temporal_fusion", "G4_interpolate_rows", "H1_rejects", "H3_decode_packets", "H7_drop_stale_frames",
    "I2_latency_summary", "J9_stamp_processing_revision", "K7_nearest_rank_percentile",
)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def test_every_query_has_its_sql():
    catalog = load_catalog()
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(df.columns) == sorted(names)
    mine = sorted(map(str, (tuple(row) for row in df.select(*sorted(df.columns)).collect())))
    assert mine == sorted(str(tuple(row[i] for i in order)) for row in result.fetchall())


@pytest.mark.parametrize("name", ("A3_bad_values", "A3_quarantine_blocks", "C10_rejected_batches", "A1_read_recordings", "A1_read_batches", "C9_measure_recordings"))
def test_short_last_buffer(spark, con, tmp_path, name):
    """1033 records: the last buffer has three."""
    wider = spark.range(1033).selectExpr("id as vec_id", "cast(id % 500 as long) as place").join(
        spark.read.parquet(f"{SF_DIR}/embeddings.parquet").selectExpr("vec_id as place", "embedding", "label"), "place").drop("place")
    wider.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    os.symlink(f"{SF_DIR}/region.parquet", tmp_path / "region.parquet")
    local = duckdb.connect()
    local.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    local.execute(f"CREATE VIEW region AS SELECT * FROM '{SF_DIR}/region.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    columns = ", ".join(sorted(df.columns))
    mine = sorted(map(str, (tuple(row) for row in df.select(*sorted(df.columns)).collect())))
    assert mine == sorted(map(str, local.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()))
