"""Registered queries of table handles, writing statements, quantities, measures and images."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import taql
from .operators import images, measures
from .operators.quanta import quantity
from .operators.rows import BASE_ROWID, ROWID
from .operators.slices import overlay, take
from .plans import dml
from .queries import ORACLE_SQL, QUERIES, Query, rows
from .session import stage_path
from .sources.ascii import read_ascii
from .sources.ms import add_imaging_columns, complete_schema, default_ms, required_schema
from .table import Table, make_array_column, make_table


def query(name: str, sql: str | None):  # noqa: ANN201
    """Register a function under a name, with SQL."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table(spark, f"{sf_dir}/{name}.parquet")


def _copy(spark: SparkSession, sf_dir: str, name: str, columns: str) -> str:
    """A table of its own, in the shared folder."""
    path = stage_path(spark, f"table-{name}")
    taql(spark, f"SELECT {columns} INTO '{path}' FROM $1", [f"{sf_dir}/{name}.parquet"])
    return path


# Views.
@query("view_query_sort", f"SELECT row_number() OVER (ORDER BY o_orderdate, rid) - 1 AS place, rid AS base, o_orderkey, o_totalprice FROM {rows('orders')} WHERE o_totalprice > 200000")
def view_query_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "orders").query("o_totalprice > 200000").sort("o_orderdate")
    return v.df().select(F.col(ROWID).alias("place"), F.col(BASE_ROWID).alias("base"), "o_orderkey", "o_totalprice")


@query("view_of_view", f"SELECT rid, place FROM (SELECT rid, row_number() OVER (ORDER BY rid) - 1 AS place, n_regionkey FROM {rows('nation')} WHERE n_regionkey > 0) WHERE n_regionkey = 2 AND place % 2 = 0")
def view_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROWID() in a query over a view is the view's position."""
    v = _table(spark, sf_dir, "nation").query("n_regionkey > 0").query("n_regionkey = 2 AND ROWID() % 2 = 0")
    base = _table(spark, sf_dir, "nation").query("n_regionkey > 0").df().select(F.col(BASE_ROWID).alias("rid"), F.col(ROWID).alias("place"))
    return base.join(v.df().select(F.col(BASE_ROWID).alias("rid")), "rid")


@query("view_rownumbers", f"SELECT a.rid AS rid, coalesce(b.place, -1) AS place FROM {rows('customer')} a LEFT JOIN (SELECT rid, row_number() OVER (ORDER BY c_acctbal DESC, rid DESC) - 1 AS place FROM {rows('customer')} WHERE c_acctbal > 5000) b ON a.rid = b.rid")
def view_rownumbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "customer")
    v = t.query("c_acctbal > 5000").sort("DESC c_acctbal").df().select(F.col(BASE_ROWID).alias("rid"), F.col(ROWID).alias("p"))
    return t.df().select(F.col(ROWID).alias("rid")).join(v, "rid", "left").select("rid", F.coalesce("p", F.lit(-1)).cast("long").alias("place"))


@query("getcol_range", f"SELECT rid, p_retailprice AS value FROM {rows('part')} WHERE rid BETWEEN 100 AND 149")
def getcol_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").column("p_retailprice", 100, 50).select(F.col(ROWID).alias("rid"), "value")


@query("cell_slice", "SELECT vec_id, round(embedding[9]::DOUBLE + embedding[10]::DOUBLE + embedding[17]::DOUBLE + embedding[18]::DOUBLE, 5) AS v FROM embeddings")
def cell_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 64 seen as 8 by 8: rows 1 and 2, columns 0 and 1."""
    from .operators.slices import flat_indices

    places, _ = flat_indices([8, 8], [1, 0], [2, 1])
    values = take(F.col("embedding").cast("array<double>"), places)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 5).alias("v"))


@query("cell_slice_write", "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])) - embedding[1]::DOUBLE - embedding[8]::DOUBLE + 3, 4) AS v FROM embeddings")
def cell_slice_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = overlay(F.col("embedding").cast("array<double>"), [0, 7], F.array(F.lit(1.0), F.lit(2.0)))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(F.aggregate(new, F.lit(0.0), lambda a, x: a + x), 4).alias("v"))


# Writing.
@query("select_into", f"SELECT rid, o_orderkey, o_totalprice FROM (SELECT row_number() OVER (ORDER BY o_totalprice, rid) - 1 AS rid, o_orderkey, o_totalprice FROM {rows('orders')})")
def select_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "into")
    taql(spark, f"SELECT o_orderkey, o_totalprice INTO '{path}' FROM $1 ORDERBY o_totalprice", [f"{sf_dir}/orders.parquet"])
    return taql(spark, "SELECT ROWID() AS rid, o_orderkey, o_totalprice FROM $1", [path], ordered=False)


_PART = "p_partkey, p_name, p_size, p_retailprice"


@query("update", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big ' ELSE p_name END AS p_name, CASE WHEN p_size > 25 THEN CAST(trunc(p_retailprice) AS INTEGER) ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN p_size + 0.5 ELSE p_retailprice END AS p_retailprice FROM part")
def update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right sides see the old values; reals stored as integers lose their fraction."""
    t = _copy(spark, sf_dir, "part", _PART)
    taql(spark, "UPDATE $1 SET p_name = 'big ', p_size = p_retailprice, p_retailprice = p_size + 0.5 WHERE p_size > 25", [t])
    return taql(spark, f"SELECT {_PART} FROM $1", [t], ordered=False)


@query("update_limit", f"SELECT p_partkey, CASE WHEN rid IN (SELECT rid FROM {rows('part')} WHERE p_size > 10 ORDER BY p_retailprice DESC, rid DESC LIMIT 7) THEN 0 ELSE p_size END AS p_size FROM {rows('part')}")
def update_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _copy(spark, sf_dir, "part", _PART)
    taql(spark, "UPDATE $1 SET p_size = 0 WHERE p_size > 10 ORDERBY p_retailprice DESC LIMIT 7", [t])
    return taql(spark, "SELECT p_partkey, p_size FROM $1", [t], ordered=False)


@query("delete", f"SELECT row_number() OVER (ORDER BY rid) - 1 AS rid, p_partkey FROM {rows('part')} WHERE NOT p_size % 3 = 0")
def delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _copy(spark, sf_dir, "part", _PART)
    taql(spark, "DELETE FROM $1 WHERE p_size % 3 = 0", [t])
    return taql(spark, "SELECT ROWID() AS rid, p_partkey FROM $1", [t], ordered=False)


@query("insert", f"SELECT rid, n_nationkey, n_name, n_regionkey FROM {rows('nation')} UNION ALL SELECT rid + 25, CAST(r_regionkey AS INTEGER), r_name, 0 FROM {rows('region')}")
def insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _copy(spark, sf_dir, "nation", "n_nationkey, n_name, n_regionkey")
    taql(spark, "INSERT INTO $1 (n_nationkey, n_name) SELECT r_regionkey, r_name FROM $2", [t, f"{sf_dir}/region.parquet"])
    return taql(spark, "SELECT ROWID() AS rid, n_nationkey, n_name, n_regionkey FROM $1", [t], ordered=False)


@query("alter", "SELECT n_nationkey, n_name AS label, CAST(0 AS DOUBLE) AS added FROM nation")
def alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _copy(spark, sf_dir, "nation", "n_nationkey, n_name, n_regionkey")
    taql(spark, "ALTER TABLE $1 ADD COLUMN added R8, DROP COLUMN n_regionkey, RENAME COLUMN n_name TO label, SET version = 2", [t])
    return taql(spark, "SELECT * FROM $1", [t], ordered=False)


@query("create_table", "SELECT CAST(0 AS INTEGER) AS a, CAST(0 AS DOUBLE) AS b, '' AS s FROM range(4)")
def create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "created")
    taql(spark, f"CREATE TABLE '{path}' [a I4, b R8 COMMENT='x', s S] KEYWORDS k=1 LIMIT 4")
    return taql(spark, "SELECT * FROM $1", [path], ordered=False)


@query("show_table", "SELECT * FROM (VALUES ('p_partkey', 'int64', -1, '', ''), ('p_name', 'string', -1, '', ''), ('p_size', 'int', -1, '', ''), ('p_retailprice', 'double', -1, '', '')) t(name, datatype, ndim, shape, comment)")
def show_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taql(spark, f"SHOW TABLE '{_copy(spark, sf_dir, 'part', _PART)}'")


@query("write_cells", f"SELECT rid, n_nationkey, CASE WHEN rid IN (3, 4) THEN rid * 100 ELSE n_regionkey END AS n_regionkey FROM {rows('nation')} UNION ALL SELECT 25, 0, 0")
def write_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Table(spark, _copy(spark, sf_dir, "nation", "n_nationkey, n_regionkey")) as t:
        t.putcol("n_regionkey", [300, 400], 3, 2)
        t.addrows(1)
    return t.df().select(F.col(ROWID).alias("rid"), F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query("remove_rows", f"SELECT row_number() OVER (ORDER BY rid) - 1 AS rid, n_name FROM {rows('nation')} WHERE rid NOT IN (0, 7, 24)")
def remove_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Table(spark, _copy(spark, sf_dir, "nation", "n_name")) as t:
        t.removerows([0, 7, 24])
    return t.df().select(F.col(ROWID).alias("rid"), "n_name")


@query("ascii_round_trip", f"SELECT rid, n_nationkey, n_name FROM {rows('nation')}")
def ascii_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as text with a line of types put in, and read again."""
    text = stage_path(spark, "ascii")
    rows_ = taql(spark, "SELECT n_nationkey, n_name FROM $1", [f"{sf_dir}/nation.parquet"])
    lines = [("n_nationkey n_name",), ("I S",), *((f"{r[0]} {r[1]}",) for r in rows_.collect())]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(text)
    t = read_ascii(spark, text, stage_path(spark, "from-ascii"))
    return t.df().select(F.col(ROWID).alias("rid"), "n_nationkey", "n_name")


@query("coercion", "SELECT p_partkey, CAST(((p_partkey * 40000 + 32768) % 65536 + 65536) % 65536 - 32768 AS SMALLINT) AS small, CAST(p_partkey AS VARCHAR) AS text, CAST(0 AS BIGINT) AS none FROM part")
def coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers wrap, anything becomes text, text becomes zero."""
    from pyspark.sql import types as T

    from .types import INT, STR, Val

    key = Val(F.col("p_partkey"), INT)
    big = Val(F.col("p_partkey") * 40000, INT)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", dml.coerced(big, T.ShortType()).alias("small"), dml.coerced(key, T.StringType()).alias("text"), dml.coerced(Val(F.col("p_name"), STR), T.LongType()).alias("none")
    )


@query("default_ms", "SELECT * FROM (VALUES ('MAIN', 21, 0), ('ANTENNA', 8, 0), ('FIELD', 9, 0), ('SPECTRAL_WINDOW', 14, 0)) t(name, columns, rows)")
def default_ms_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "ms")
    ms = default_ms(spark, path)
    found = [("MAIN", ms.ncols(), len(ms))]
    found += [(n, (s := ms.subtable(n)).ncols(), len(s)) for n in ("ANTENNA", "FIELD", "SPECTRAL_WINDOW")]
    return spark.createDataFrame(found, "name string, columns int, rows int")


@query("imaging_columns", "SELECT i AS rid, 8 AS model, 8 AS corrected, 4 AS weights FROM range(3) t(i)")
def imaging_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = default_ms(spark, stage_path(spark, "ms"), make_table([make_array_column("DATA", 1j, shape=[4, 2])]))
    ms.addrows(3)
    ms.flush()
    add_imaging_columns(ms)
    df = Table(spark, ms.path).df()
    return df.select(F.col(ROWID).alias("rid"), F.size("MODEL_DATA").alias("model"), F.size("CORRECTED_DATA").alias("corrected"), F.size("IMAGING_WEIGHT.data").alias("weights"))


@query("ms_schemas", None)
def ms_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All known columns of all tables, and which are required."""
    from .sources.ms import REQUIRED

    found = [(t, f.name, f.dataType.simpleString(), f.name in required_schema(t).names) for t in REQUIRED for f in complete_schema(t)]
    return spark.createDataFrame(found, "table string, column string, type string, required boolean")


# Quantities and measures.
@query("quanta_convert", "SELECT o_orderkey, round(o_totalprice / 3600, 6) AS hours, round(o_custkey * pi() / 180, 6) AS radians, round(o_totalprice * 1000 / 60, 4) AS speed FROM orders")
def quanta_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds, degrees = quantity(F.col("o_totalprice"), "s"), quantity(F.col("o_custkey").cast("double"), "deg")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.round(seconds.get_value("h"), 6).alias("hours"), F.round(degrees.get_value("rad"), 6).alias("radians"), F.round(quantity(F.col("o_totalprice"), "km/min").get_value("m/s"), 4).alias("speed")
    )


@query("quanta_arithmetic", "SELECT o_orderkey, round(o_totalprice + o_custkey / 1000, 5) AS total, round(o_totalprice * o_custkey, 2) AS product, round(sqrt(o_totalprice * 1e6), 4) AS root, abs(o_totalprice - o_custkey / 1000) <= 1e5 AS near FROM orders")
def quanta_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = quantity(F.col("o_totalprice"), "km"), quantity(F.col("o_custkey").cast("double"), "m")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.round((a + b).value, 5).alias("total"), F.round((a * b).value, 2).alias("product"),
        F.round(quantity(F.col("o_totalprice"), "km2").sqrt().value, 4).alias("root"), a.nearabs(b, 1e5).alias("near"),
    )


@query("quanta_format", "SELECT l_orderkey, l_linenumber, printf('%02d:%02d:00', CAST(l_quantity AS BIGINT) * 20 // 60 % 24, CAST(l_quantity AS BIGINT) * 20 % 60) AS clock FROM lineitem")
def quanta_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", quantity(F.col("l_quantity") * 20, "min").formatted_column().alias("clock"))


_LON, _LAT = "(c_custkey % 360) * pi() / 180", "((c_custkey * 7) % 170 - 85) * pi() / 180"


def _sky(df: DataFrame) -> tuple[DataFrame, tuple]:
    lon, lat = (F.col("c_custkey") % 360) * math.pi / 180, ((F.col("c_custkey") * 7) % 170 - 85) * math.pi / 180
    return df, (F.lit(1.0), F.lit(0.5), lon, lat)


@query("posangle", f"SELECT c_custkey, round(atan2(cos(b)*sin(a-1), cos(0.5)*sin(b)-sin(0.5)*cos(b)*cos(a-1)), 8) AS pa, round(acos(greatest(-1, least(1, sin(0.5)*sin(b)+cos(0.5)*cos(b)*cos(a-1)))), 5) AS sep FROM (SELECT c_custkey, {_LON} AS a, {_LAT} AS b FROM customer)")
def posangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, args = _sky(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return df.select("c_custkey", F.round(measures.position_angle(*args), 8).alias("pa"), F.round(measures.separation(*args), 5).alias("sep"))


@query("epoch_tai", "SELECT o_orderkey, CAST(CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 32 WHEN o_orderdate >= TIMESTAMP '1997-07-01' THEN 31 WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 30 WHEN o_orderdate >= TIMESTAMP '1994-07-01' THEN 29 WHEN o_orderdate >= TIMESTAMP '1993-07-01' THEN 28 WHEN o_orderdate >= TIMESTAMP '1992-07-01' THEN 27 ELSE 26 END AS BIGINT) AS leap FROM orders")
def epoch_tai(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = taql(spark, "SELECT o_orderkey, MJD(o_orderdate) AS m FROM $1", [f"{sf_dir}/orders.parquet"], ordered=False)
    late = df.select("o_orderkey", F.greatest("m", F.lit(48257.0)).alias("m"))
    return late.select("o_orderkey", F.round((measures.convert_epoch(F.col("m"), "UTC", "TAI") - F.col("m")) * 86400).cast("long").alias("leap"))


@query("position_wgs84", f"SELECT c_custkey, round({_LON} - CASE WHEN c_custkey % 360 > 180 THEN 2 * pi() ELSE 0 END, 8) AS lon, round({_LAT}, 8) AS lat, round(CAST(c_custkey % 5000 AS DOUBLE), 3) AS h FROM customer")
def position_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To geocentric metres and back."""
    df, (_, _, lon, lat) = _sky(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    x, y, z = measures.wgs84_to_itrf(lon, lat, (F.col("c_custkey") % 5000).cast("double"))
    at = df.select("c_custkey", x.alias("x"), y.alias("y"), z.alias("z"))
    a, b, h = measures.itrf_to_wgs84(F.col("x"), F.col("y"), F.col("z"))
    return at.select("c_custkey", F.round(a, 8).alias("lon"), F.round(b, 8).alias("lat"), F.round(h, 3).alias("h"))


@query("horizon", None)
def horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2000 to the horizon of one site, and back."""
    df, (_, _, lon, lat) = _sky(spark.read.parquet(f"{sf_dir}/customer.parquet"))
    site = (0.3742, -0.5360, 1050.0)
    when = (F.lit(57844.5) + F.col("c_custkey") / 1000).cast("double")
    up = df.select("c_custkey", when.alias("m"), measures.to_horizon(lon, lat, when, site).alias("h"))
    back = up.select("c_custkey", "h", measures.to_horizon(F.col("h.lon"), F.col("h.lat"), F.col("m"), site, back=True).alias("b"))
    return back.select("c_custkey", F.round("h.lon", 8).alias("az"), F.round("h.lat", 8).alias("alt"), F.round("b.lon", 8).alias("lon"), F.round("b.lat", 8).alias("lat"))


# Images.
_COORDS = images.Coordinates((images.Axis("RA", 1.75, -2.5e-3, 5), images.Axis("DEC", -0.45, 3e-3, 4)), (0, 1))


@query("image_world", "SELECT vec_id, round(CAST(vec_id % 11 AS DOUBLE), 6) AS x, round(CAST(vec_id % 9 AS DOUBLE), 6) AS y FROM embeddings")
def image_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel to world and back."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    world = _COORDS.to_world([(F.col("vec_id") % 11).cast("double"), (F.col("vec_id") % 9).cast("double")])
    at = df.select("vec_id", world[0].alias("lon"), world[1].alias("lat"))
    x, y = _COORDS.to_pixel([F.col("lon"), F.col("lat")])
    return at.select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("image_regrid", "SELECT vec_id * 63 + i AS pix, round((embedding[i + 1]::DOUBLE + embedding[i + 2]::DOUBLE) / 2, 4) AS value FROM embeddings, range(63) t(i)")
def image_regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as an image of one row each, moved by half a pixel along its rows."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = df.count()
    pixels = df.select((F.col("vec_id") * 64).alias("b"), F.posexplode("embedding").alias("i", "value")).select((F.col("b") + F.col("i")).alias("pix"), "value")
    axes = (images.Axis("x", 0.0, 1.0, 0.0), images.Axis("y", 0.0, 1.0, 0.0))
    source = images.Image(pixels, (n, 64), images.Coordinates(axes))
    out = images.regrid(source, [1], source.coordinates.with_axis(0, crpix=-0.5), (n, 63))
    return out.pixels.select("pix", F.round(F.col("value").cast("double"), 4).alias("value"))
