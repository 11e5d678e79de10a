"""Tables of a data folder, geometry derived from their keys, and tables kept for a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_TEMP: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the folder that driver and executors share (spark.checkpoint.dir; a temporary one in local mode) and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _TEMP:
            _TEMP.append(tempfile.mkdtemp(prefix="quadrille-"))
        base = _TEMP[0]
    path = f"{base.rstrip('/')}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _coord(key: str, factor: int) -> str:
    return f"CAST(({key}*{factor})%100003 AS DOUBLE)/1000"


#: Geometry derived from the keys of the driver's tables; the same SQL runs on Spark and DuckDB.
VIEWS: dict[str, tuple[str, str]] = {
    "g_balls": ("supplier", f"SELECT s_suppkey AS id, s_nationkey AS grp, {_coord('s_suppkey', 7919)} AS x, {_coord('s_suppkey', 50021)} AS y, {_coord('s_suppkey', 31337)} AS z, CAST(12 + s_suppkey%7 AS DOUBLE)/2 AS r FROM supplier"),
    "g_boxes": ("part", f"SELECT p_partkey AS id, {_coord('p_partkey', 7919)} AS cx, {_coord('p_partkey', 50021)} AS cy, {_coord('p_partkey', 31337)} AS cz, CAST(p_size AS DOUBLE)/8 AS hx, CAST(1 + p_partkey%20 AS DOUBLE)/4 AS hy, CAST(1 + p_partkey%30 AS DOUBLE)/5 AS hz FROM part"),
    "g_points": ("customer", f"SELECT c_custkey AS id, c_nationkey AS grp, {_coord('c_custkey', 7907)} AS x, {_coord('c_custkey', 50023)} AS y, {_coord('c_custkey', 31327)} AS z FROM customer"),
    "g_rays": ("orders", f"SELECT o_orderkey AS id, {_coord('o_orderkey', 7901)} AS ox, {_coord('o_orderkey', 49999)} AS oy, {_coord('o_orderkey', 31333)} AS oz, CAST(o_orderkey%5 - 2 AS DOUBLE) AS dx, CAST(o_orderkey%7 - 3 AS DOUBLE) AS dy, CAST(o_orderkey%11 - 5 AS DOUBLE) AS dz FROM orders WHERE o_orderkey%50 = 7 AND NOT (o_orderkey%5 = 2 AND o_orderkey%7 = 3 AND o_orderkey%11 = 5)"),
    "g_segments": ("part", f"SELECT p_partkey AS id, {_coord('p_partkey', 7883)} AS ax, {_coord('p_partkey', 50033)} AS ay, {_coord('p_partkey', 31319)} AS az, {_coord('p_partkey', 7883)} + CAST(p_partkey%9 - 4 AS DOUBLE) AS bx, {_coord('p_partkey', 50033)} + CAST(p_partkey%13 - 6 AS DOUBLE) AS by_, {_coord('p_partkey', 31319)} + CAST(p_size AS DOUBLE)/10 AS bz FROM part"),
    "g_triangles": ("part", f"SELECT p_partkey AS id, {_coord('p_partkey', 7879)} AS ax, {_coord('p_partkey', 50047)} AS ay, {_coord('p_partkey', 31307)} AS az, {_coord('p_partkey', 7879)} + CAST(2 + p_partkey%5 AS DOUBLE) AS bx, {_coord('p_partkey', 50047)} + CAST(p_partkey%3 AS DOUBLE) AS by_, {_coord('p_partkey', 31307)} AS bz, {_coord('p_partkey', 7879)} AS cx, {_coord('p_partkey', 50047)} + CAST(1 + p_size%7 AS DOUBLE) AS cy, {_coord('p_partkey', 31307)} + CAST(p_partkey%4 AS DOUBLE) AS cz FROM part"),
    "g_moving": ("events", f"SELECT event_id AS id, user_id AS entity, ts, {_coord('user_id', 7919)} + value/100 AS x, {_coord('user_id', 50021)} + CAST(event_id%10 AS DOUBLE)/10 AS y, CAST(1 + user_id%3 AS DOUBLE)/2 AS h, CAST(event_id%5 - 2 AS DOUBLE) AS vx, CAST(event_id%7 - 3 AS DOUBLE) AS vy FROM events"),
    "g_voxels": ("lineitem", "SELECT DISTINCT l_partkey%20 AS ix, l_suppkey%20 AS iy, CAST(l_linenumber AS BIGINT) AS iz FROM lineitem WHERE (l_orderkey + l_partkey)%13 < 3"),
    "g_height": ("part", "SELECT p_partkey%16 AS i, CAST(floor(p_partkey/16) AS BIGINT)%16 AS j, CAST(max(p_size) AS DOUBLE)/10 AS h FROM part GROUP BY p_partkey%16, CAST(floor(p_partkey/16) AS BIGINT)%16"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over its one source table."""
    source, sql = VIEWS[name]
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source))
