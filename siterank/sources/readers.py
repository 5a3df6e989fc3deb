"""File sources.  Every reader has a fixed schema and gives rows an explicit ``ordinal``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siterank.functions import text as tx
from siterank.functions.geo import require_wgs84, ring_area
from siterank.operators.ordering import dense_ordinal
from siterank.operators.tables import alias_column, find_alias
from siterank.sources.json_elements import read_elements
from siterank.sources.shapefile import read_shapefile_points

POINT = "struct<type:string,coordinates:array<double>>"
PROVENANCE = "struct<states:array<string>,quads:array<string>,years:array<string>>"


def with_file_order(df: DataFrame) -> DataFrame:
    """``ordinal`` by file name, position of the block in the file, then row order."""
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__row"),
    )
    return dense_ordinal(tagged, ["__file", "__start", "__row"]).drop("__file", "__start", "__row")


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str], ordered: bool = True) -> DataFrame:
    """CSV with a header, all columns as text; casts belong to the plans."""
    df = spark.read.schema(string_schema(columns)).option("header", True).csv(path)
    return with_file_order(df) if ordered else df


def read_candidate_folder(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV per county; ``county_group`` is the file name without its suffix."""
    df = spark.read.schema("`Potential UOW id` string, `Coordinates` string").option("header", True).csv(folder)
    named = df.select(
        F.col("`Potential UOW id`").alias("uid"),
        F.col("Coordinates").alias("coordinates"),
        F.regexp_replace(F.url_decode(F.col("_metadata.file_name")), r"(_UOWs)?\.csv$", "").alias("county_group"),
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__row"),
    )
    return dense_ordinal(named, ["__file", "__start", "__row"]).drop("__file", "__start", "__row")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON arrays; a file whose root is a keyed object is refused."""
    return _parsed(read_elements(spark, path, root="["), schema).select("v.*")


def read_keyed(spark: SparkSession, path: str, value_schema: str, key: str = "well_id") -> DataFrame:
    """``{id: {...}}`` objects to one row per id."""
    found = _parsed(read_elements(spark, path, keyed=True, root="{"), value_schema)
    return found.select(F.from_json(F.concat(F.lit('{"k":'), "key", F.lit("}")), "k string")["k"].alias(key), "v.*")


def _parsed(elements: DataFrame, schema: str) -> DataFrame:
    return elements.withColumn("v", F.from_json("value", f"struct<{schema}>" if not schema.startswith("struct<") else schema))


def _features(spark: SparkSession, path: str, geometry: str, properties: str, lines: bool) -> DataFrame:
    """Features of collections, or of files with one feature per line; both are read in splits."""
    feature = f"struct<geometry:{geometry},properties:{properties}>"
    if lines:
        df = spark.read.schema(f"geometry {geometry}, properties {properties}").json(path)
        tagged = df.select(
            "geometry", "properties", F.col("_metadata.file_path").alias("__file"),
            F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__pos"),
        )
    else:
        df = _parsed(read_elements(spark, path, level=2, root="{"), feature)
        tagged = df.select("v.geometry", "v.properties", F.col("file").alias("__file"), F.lit(0).alias("__at"), F.col("number").alias("__pos"))
    return dense_ordinal(tagged, ["__file", "__at", "__pos"])


def read_geojson_points(spark: SparkSession, path: str, properties: str = "struct<>", lines: bool = False,
                        crs: str = "EPSG:4326") -> DataFrame:
    """Point features as lon, lat and the property columns; other geometries are skipped."""
    require_wgs84(crs)
    props = properties if properties != "struct<>" else "map<string,string>"
    df = _features(spark, path, POINT, props, lines).where(
        (F.col("geometry.type") == "Point") & (F.size("geometry.coordinates") >= 2)
    )
    cols = ["properties.*"] if props.startswith("struct") else ["properties"]
    return df.select(
        F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"),
        *cols, "ordinal", F.col("__file").alias("input_file"),
    )


def read_dated_points(spark: SparkSession, path: str, date_field: str, lines: bool = False) -> DataFrame:
    """Points with the year found in one property; null when there is none."""
    df = read_geojson_points(spark, path, f"struct<`{date_field}`:string>", lines)
    return df.select("lon", "lat", tx.year_in_text(f"`{date_field}`").alias("year"), "ordinal")


def read_known_points(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Known sites from GeoJSON or from a CSV with latitude and longitude columns."""
    if path.lower().endswith((".geojson", ".json")):
        return read_geojson_points(spark, path).select("lon", "lat", "ordinal")
    df = read_csv(spark, path, columns or [])
    if not (find_alias(df, ["latitude", "lat"]) and find_alias(df, ["longitude", "lon", "long"])):
        raise ValueError(f"{path} has no latitude and longitude columns")
    return df.select(
        tx.to_double(alias_column(df, ["longitude", "lon", "long"])).alias("lon"),
        tx.to_double(alias_column(df, ["latitude", "lat"])).alias("lat"),
        "ordinal",
    )


def read_detections(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Detections with the provenance of their first source record; incomplete ones are skipped."""
    rec = f"struct<source_records:array<struct<feature:struct<properties:{PROVENANCE}>>>>"
    df = _features(spark, path, POINT, rec, lines)
    p = F.get("properties.source_records", F.lit(0))["feature"]["properties"]
    first = {n: F.get(p[c], F.lit(0)) for n, c in (("state", "states"), ("quad", "quads"), ("year", "years"))}
    return (
        df.withColumns(first)
        .where("state is not null and quad is not null and year is not null")
        .select(
            F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"),
            tx.strip("state").alias("state"), tx.strip("quad").alias("quad"), tx.strip("year").alias("year"), "ordinal",
        )
    )


def read_map_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Per-map detection collections for the merge, with their file and collection metadata."""
    props = "struct<source:string,scan_id:string,quad:string,quad_year:string,state:string,dist_to_documented_m:int>"
    df = read_geojson_points(spark, folder, props)
    return df.withColumn("collection_metadata", F.struct(F.lit("FeatureCollection").alias("type")))


def read_columnar(spark: SparkSession, path: str, states: list[str] | None = None) -> DataFrame:
    """Dictionary-encoded columns (legends and index arrays) back to rows; index -1 is null."""
    schema = (
        "count long, state_legend array<string>, type_legend array<string>, status_legend array<string>, "
        "lon array<double>, lat array<double>, state_idx array<int>, type_idx array<int>, status_idx array<int>"
    )
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return decode_columnar(df, states)


def decode_columnar(df: DataFrame, states: list[str] | None = None) -> DataFrame:
    rows = df.select(
        "state_legend", "type_legend", "status_legend",
        F.posexplode(F.arrays_zip("lon", "lat", "state_idx", "type_idx", "status_idx")).alias("ordinal", "r"),
    )

    def value(legend, idx):
        return F.when(F.col(idx) >= 0, F.get(legend, F.col(idx)))

    out = rows.select(
        F.col("ordinal").cast("long").alias("ordinal"), "r.lon", "r.lat",
        value("state_legend", "r.state_idx").alias("state"), value("type_legend", "r.type_idx").alias("type_norm"),
        value("status_legend", "r.status_idx").alias("status_norm"),
    )
    return out.where(F.col("state").isin(states)) if states else out


def polygon_rings(geometry):
    """Polygon or MultiPolygon coordinates to oriented rings: shells positive, holes negative."""
    def oriented(ring, shell):
        points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
        want = (ring_area(points) >= 0) == shell
        return F.when(want, points).otherwise(F.reverse(points))

    polygons = F.when(
        geometry["type"] == "Polygon", F.array(F.from_json(geometry["coordinates"], "array<array<array<double>>>"))
    ).otherwise(F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>"))
    return F.flatten(F.transform(polygons, lambda poly: F.transform(poly, lambda ring, i: oriented(ring, i == 0))))


def read_polygons(spark: SparkSession, path: str, attrs: dict[str, str], states: list[str] | None = None,
                  crs: str = "EPSG:4326", lines: bool = False) -> DataFrame:
    """Polygon layer with ``rings``; of ``states`` only the folders ``state_abbr=…`` are listed and read."""
    require_wgs84(crs)
    fields = ",".join(f"`{s}`:string" for s in attrs)
    if states is not None:
        path = f"{path}/state_abbr={{{','.join(states)}}}"
        if not states or not path_exists(spark, path):
            columns = "".join(f"`{d}` string, " for d in attrs.values())
            return spark.createDataFrame([], f"{columns}rings array<array<struct<x:double,y:double>>>, ordinal long")
    df = _features(spark, path, "struct<type:string,coordinates:string>", f"struct<{fields}>", lines)
    df = df.where(F.col("geometry.type").isin("Polygon", "MultiPolygon"))
    return df.select(
        *[F.col(f"properties.`{s}`").alias(d) for s, d in attrs.items()], polygon_rings(F.col("geometry")).alias("rings"), "ordinal",
    )


def project_rings(layer: DataFrame) -> DataFrame:
    """Rings from degrees to planar metres."""
    from siterank.functions.geo import AlbersConus

    def moved(p):
        x, y = AlbersConus.xy(p["y"], p["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    return layer.withColumn("rings", F.transform("rings", lambda r: F.transform(r, moved)))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of rows whose first row is the header, as one map column ``row``."""
    m = F.from_json("value", "array<array<string>>")
    df = spark.read.text(path, wholetext=True).select(m.alias("m"))
    header = F.get("m", F.lit(0))
    return df.select(header.alias("h"), F.explode(F.slice("m", 2, F.size("m"))).alias("r")).select(
        F.map_from_arrays("h", "r").alias("row")
    )


def read_block_group_counts(spark: SparkSession, path: str) -> DataFrame:
    return read_matrix(spark, path).select(
        *[F.col("row").getItem(k).alias(a) for k, a in (
            ("B01003_001E", "B01003_001E"), ("state", "state"), ("county", "county"), ("tract", "tract"),
            ("block group", "block_group"))]
    )


def read_map_bounds(spark: SparkSession, path: str) -> DataFrame:
    """Box of each map from its metadata sidecar: first ``bounding`` element per file."""
    df = (
        spark.read.format("xml").option("rowTag", "bounding")
        .schema("westbc double, eastbc double, northbc double, southbc double").load(path)
        .select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("__row"))
    )
    return df.groupBy("file").agg(
        F.min_by(F.struct("westbc", "eastbc", "northbc", "southbc"), "__row").alias("b")
    ).select("file", F.col("b.westbc").alias("west"), F.col("b.eastbc").alias("east"),
             F.col("b.northbc").alias("north"), F.col("b.southbc").alias("south"))


def read_bulk(spark: SparkSession, path: str, fmt: str, columns: list[str]) -> DataFrame:
    """Bulk registry by format; point layers carry ``__lon`` and ``__lat``."""
    if fmt == "csv":
        return read_csv(spark, path, columns)
    if fmt == "json":
        df = spark.read.schema(string_schema(columns)).option("multiLine", True).json(path)
        return with_file_order(df)
    if fmt == "shp":
        df = read_shapefile_points(spark, path, columns)
        return df.select(*columns, F.col("lon").alias("__lon"), F.col("lat").alias("__lat"), F.col("record").alias("ordinal"))
    if fmt == "geojson":
        props = "struct<" + ",".join(f"`{c}`:string" for c in columns) + ">"
        df = read_geojson_points(spark, path, props)
        return df.withColumnsRenamed({"lon": "__lon", "lat": "__lat"}).drop("input_file")
    raise ValueError(f"unknown bulk format: {fmt}")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def first_available(spark: SparkSession, tries: list, schema: str) -> DataFrame:
    """First (path, reader) that exists and has rows; an empty table of the schema when none does."""
    for path, reader in tries:
        if not path_exists(spark, path):
            continue
        try:
            df = reader(spark, path)
        except AnalysisException:
            continue
        if df is not None and df.take(1):
            return df
    return spark.createDataFrame([], schema)


def cached_table(spark: SparkSession, path: str, build, refresh: bool = False) -> DataFrame:
    """Landing table: read it when it is there, else build and write it."""
    if refresh or not path_exists(spark, path):
        build(spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
