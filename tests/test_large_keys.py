"""Queries on a few rows with the keys of larger tables, where rounding or a bound once made a difference, against their SQL on DuckDB."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quadrille import queries as geometry


def differs(spark, folder, name, **tables):
    """Rows of the query, and those that only it or only its SQL has."""
    for table, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows, pa.schema([(c, pa.int64()) for c in rows[0]])), f"{folder}/{table}.parquet")
    got = sorted(tuple(r) for r in geometry.QUERIES[name](spark, str(folder)).collect())
    c = duckdb.connect()
    for table in tables:
        c.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = sorted(c.sql(geometry.oracle_sql()[name]).fetchall())
    return got, [r for r in got if r not in want], [r for r in want if r not in got]


def suppliers(*keys):
    return [{"s_suppkey": k, "s_nationkey": k % 25} for k in keys]


def parts(*keys):
    return [{"p_partkey": k, "p_size": 1 + k % 50} for k in keys]


def test_slivers_of_polygons(spark, tmp_path):
    # Squares that overlap by 14.6 and, but for rounding, 0.001; others share more or nothing.
    got, extra, missing = differs(spark, tmp_path, "polygon_intersection", supplier=suppliers(4, 3363, 11, 3370, *range(100, 140)))
    assert got and not extra and not missing


def test_rays_through_ends_of_segments(spark, tmp_path):
    keys = {762357: 7498, 766407: 107577, 767407: 102845, 629357: 32844}
    got, extra, missing = differs(spark, tmp_path, "ray_segment_2d", orders=[{"o_orderkey": k} for k in keys], part=parts(*keys.values(), *range(50)))
    assert set(keys.items()) <= {r[:2] for r in got} and not extra and not missing


def test_compounds_on_boxes_of_like_and_unlike_sizes(spark, tmp_path):
    balls = suppliers(*range(1, 200))
    got, extra, missing = differs(spark, tmp_path, "compound_manifolds", supplier=balls, part=parts(*range(60)))
    assert got and not extra and not missing
    got, extra, missing = differs(spark, tmp_path, "compound_manifolds", supplier=balls, part=[*parts(*range(60)), {"p_partkey": 77, "p_size": 900}])
    assert got and not extra and not missing
