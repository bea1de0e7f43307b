"""A selection of registered queries against their SQL, and the contract of the registry."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

NAMES = (
    "q1_frames_at_point q3_frames_in_view q4_frame_neighbours n6_address_rules n9_utc_agrees t5_copies t8_ground_track a3_azimuth_report e3_outcomes p9_terrain_height "
    "p13_region_under p17_needed_frames m9_s14_attributes m18_hit_test c5_tiles_for_areas c8_depth_under_budget c11_nodes_for_view i3_region_plan"
).split()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sql_neighbours(spark, sf):
    from aerolens.catalog import domain
    from aerolens.operators import select

    f = domain.frames(spark, sf)
    f.createOrReplaceTempView("frames")
    select.register_neighbours(spark)
    name = f.where("cam = 1 AND j = 5 AND i = 0").first()["filename"]
    got = {(r.direction, r.filename) for r in spark.sql(f"SELECT * FROM frame_neighbors('{name}')").collect()}
    want = {(r.direction, r.filename) for r in select.frame_neighbours(f).where(f"of = '{name}'").collect()}
    assert got == want and len(got) == 2
