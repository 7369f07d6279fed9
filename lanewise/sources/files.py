"""Readers for shipments, tender files, regions and branch offices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.schema import BRIDGE_HEADERS, CATEGORIES, NAME_HEADERS, OFFICE_HEADERS, POSTAL_HEADERS, SHIPMENT_HEADERS

FORMATS = ("parquet", "orc", "csv", "json")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A table in any of the columnar or text formats, text with a header line."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=False)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def select_shipments(table: DataFrame) -> DataFrame:
    """The shipment columns of a table, under our names.

    ``ship_date`` is added as null when there is none. The two categories are
    kept only together.
    """
    df = table.withColumnsRenamed({k: v for k, v in SHIPMENT_HEADERS.items() if k in table.columns})
    if "ship_date" not in df.columns:
        df = df.withColumn("ship_date", F.lit(None).cast("date"))
    both = all(c in df.columns for c in CATEGORIES)
    wanted = [c for c in SHIPMENT_HEADERS.values() if both or c not in CATEGORIES]
    return df.select(*wanted)


#: Of several tables written together: the folder that lists them, and its columns.
LIST = "exports"
EXPORTS = "number bigint, export string, name string, format string, path string"


def _exports(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(EXPORTS).json(f"{path.rstrip('/')}/{LIST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_export(spark: SparkSession, path: str) -> int | None:
    """The number of the last whole export below ``path``, null if there is none."""
    found = _exports(spark, path)
    return None if found is None else found.agg(F.max("number")).first()[0]


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last whole export below ``path``, by name; none if there is no export.

    Of two exports that were written at the same time, one counts.
    """
    found = _exports(spark, path)
    if found is None:
        return {}
    last = found.agg(F.max(F.struct("number", "export")).alias("m")).select("m.*")
    listed = found.join(last, ["number", "export"]).select("name", "format", "path").collect()  # a row per table
    return {row["name"]: read_table(spark, row["path"], row["format"]) for row in listed}


def read_shipments(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return select_shipments(read_table(spark, path, fmt))


def trim_headers(table: DataFrame) -> DataFrame:
    return table.withColumnsRenamed({c: c.strip() for c in table.columns if c != c.strip()})


def read_bid(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A tender file with every cell as text and headers without outer blanks."""
    table = trim_headers(read_table(spark, path, fmt))
    return table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in table.columns])


def select_columns(table: DataFrame, headers: Mapping[str, str], order: str | None = None) -> DataFrame:
    """The columns of a reference table under our names; a missing one is null.

    ``order`` adds a column that numbers the rows of a table just read in the
    order of its file, with gaps, files in the order of their paths.
    """
    named = {c.strip(): c for c in table.columns}
    chosen = [
        (F.col(f"`{named[h]}`") if h in named else F.lit(None).cast("string")).alias(name) for h, name in headers.items()
    ]
    if not order:
        return table.select(*chosen)
    placed = table.select(*chosen, _file_position(table).alias(order)).orderBy(order)
    return placed.withColumn(order, F.monotonically_increasing_id())


def _file_position(table: DataFrame) -> Column:
    """Where a row of a table just read is in its files, to be compared only.

    The number alone would not do: Spark reads the largest parts first.
    """
    part = table.metadataColumn("_metadata")
    return F.struct(part["file_path"], part["file_block_start"], F.monotonically_increasing_id().alias("row"))


def read_bridge(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Regions of all levels by zone; ``seq`` tells which row of a zone comes first."""
    return select_columns(read_table(spark, path, fmt), BRIDGE_HEADERS, "seq")


def read_offices(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Branch offices, their position as numbers."""
    offices = select_columns(read_table(spark, path, fmt), OFFICE_HEADERS)
    return offices.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "lon")})


def read_country_names(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The wide list of country names, in the order of the file."""
    return select_columns(read_table(spark, path, fmt), NAME_HEADERS, "ord")


def read_postal(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The reference list of postal zones, in the order of the file."""
    return select_columns(read_table(spark, path, fmt), POSTAL_HEADERS, "ord")


_POINT = T.ArrayType(T.DoubleType())
_RINGS = T.ArrayType(T.ArrayType(_POINT))

# A polygon is read as one part of a multipolygon, so both have the same depth.
FEATURE = T.StructType(
    [
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "geometry",
            T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]),
        ),
    ]
)


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """GeoJSON features with their file position, of which the lower one comes first.

    ``lines=True`` reads one feature per line, which Spark can split; a plain
    GeoJSON file is one document and is parsed by one task.
    """
    if lines:
        features = spark.read.schema(FEATURE).json(path)
        return features.withColumn("seq", _file_position(features))
    document = T.StructType([T.StructField("features", T.ArrayType(FEATURE))])
    whole = spark.read.schema(document).option("multiLine", True).json(path)
    return whole.select(F.posexplode("features").alias("seq", "feature")).select("feature.*", "seq")


def _parts() -> Column:
    text = F.col("geometry.coordinates")
    multi = F.from_json(text, T.ArrayType(_RINGS))
    single = F.array(F.from_json(text, _RINGS))
    return F.when(F.col("geometry.type") == "MultiPolygon", multi).otherwise(single)


def region_vertices(features: DataFrame, id_property: str) -> DataFrame:
    """One row per polygon vertex; of regions listed twice the first one counts."""
    keyed = features.select(F.col("properties").getItem(id_property).alias("region_id"), "geometry", "seq")
    # The first geometry of each region is chosen as text, so that only it is parsed.
    first = keyed.groupBy("region_id").agg(F.min_by("geometry", "seq").alias("geometry"))
    parsed = first.select("region_id", _parts().alias("parts"))
    rings = parsed.select("region_id", F.posexplode("parts").alias("part", "rings")).select(
        "region_id", "part", F.posexplode("rings").alias("ring", "points")
    )
    points = rings.select("region_id", "part", "ring", F.posexplode("points").alias("seq", "point"))
    return points.select(
        "region_id", "part", "ring", "seq", F.col("point")[0].alias("lon"), F.col("point")[1].alias("lat")
    )


def region_attributes(
    features: DataFrame, level: int, id_: str, name: str, lat: str | None = None, lon: str | None = None
) -> DataFrame:
    """Name and position of the regions of one level; of regions listed twice the first one counts."""
    properties = F.col("properties")

    def number(key: str | None) -> Column:
        return properties.getItem(key).try_cast("double") if key else F.lit(None).cast("double")

    listed = features.select(
        properties.getItem(id_).alias("region_id"),
        F.struct(properties.getItem(name).alias("name"), number(lat).alias("lat"), number(lon).alias("lon")).alias("a"),
        "seq",
    )
    first = listed.groupBy("region_id").agg(F.min_by("a", "seq").alias("a"))
    return first.select(F.lit(level).alias("lvl"), "region_id", "a.*")


def branch_points(offices: DataFrame) -> DataFrame:
    """Position and contact of each branch office."""
    return offices.select("office_name", "zone", "phone", "opening_hours", "lat", "lon")


def branch_countries(offices: DataFrame) -> DataFrame:
    return offices.select("country").distinct()
