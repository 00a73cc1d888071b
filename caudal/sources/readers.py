"""Scans: delimited text, code books, nested catalogs, caches, graph files, lakes of files."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as nz
from ..operators import roles
from ..session import cut

# What text files write for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)

CATALOG = "id long, nome string, microrregiao struct<mesorregiao: struct<UF: struct<sigla: string>>>"
CENTRES = "source string, cached_at_utc string, centroids map<string, struct<lat: string, lon: string>>"
FACILITIES = "source string, cached_at_utc string, facilities map<string, struct<name: string, municipality_code: string, latitude: string, longitude: string>>"


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ";", null_tokens: Iterable[str] = NULL_TOKENS, line_breaks: bool | None = None) -> DataFrame:
    """Every column a string, so that ids keep their zeros; a byte order mark is dropped; null tokens become null.

    ``line_breaks``: whether values may hold line breaks; such a file can't be split over tasks. If not given, the lines are looked
    through for one with a quote left open.
    """
    if line_breaks is None:
        line_breaks = not spark.read.text(path).where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", line_breaks).csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    df = df.toDF(*names)
    tokens = list(null_tokens)
    return df.select(*[F.when(F.col(f"`{c}`").isin(tokens), None).otherwise(F.col(f"`{c}`")).alias(c) for c in names])


def read_header(spark: SparkSession, path: str, sep: str = ";") -> list[str]:
    """The fields of the first line that isn't blank."""
    line = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    return [] if line is None else [c.strip().strip('"') for c in line[0].lstrip("﻿").split(sep)]


def transfer_codes(book: DataFrame, limit: int = 10_000) -> list[str]:
    """The code book's distinct non-blank codes that are transfers and validated (a few dozen); more than ``limit`` raise."""
    if missing := {"code", "is_transfer", "validated"} - set(book.columns):
        raise ValueError(f"the code book lacks {', '.join(sorted(missing))}")
    ok = nz.truthy_code(F.col("is_transfer")) & nz.truthy_code(F.col("validated")) & (nz.text(F.col("code")) != "")
    codes = sorted(r[0] for r in book.where(ok).select(nz.text(F.col("code"))).distinct().limit(limit + 1).collect())
    if len(codes) > limit:
        raise ValueError(f"the code book has more than {limit} transfer codes")
    return codes


def read_projected(spark: SparkSession, path: str, with_linkage: bool = False) -> DataFrame:
    """A Parquet lake in the canonical columns; only those that are mapped get read."""
    return roles.project(spark.read.parquet(path), with_linkage)


def read_months(spark: SparkSession, root: str, year: int, months: list[int], ufs: list[str] | None = None) -> DataFrame:
    """A lake laid out year=/month=/uf=; the filters prune folders before any file is opened."""
    keep = (F.col("year") == year) & F.col("month").isin(months)
    return spark.read.parquet(root).where(keep & F.col("uf").isin(ufs) if ufs else keep)


def list_raw(spark: SparkSession, root: str, suffix: str = "dbc", years: list[int] | None = None, months: list[int] | None = None, ufs: list[str] | None = None) -> DataFrame:
    """(path, size, year, month, uf) of the raw files of a lake, without reading them, those of some years, months and states only
    if these are given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]+)/", 1)
    out = files.select("path", F.col("length").alias("size"), part("year").try_cast("int").alias("year"), part("month").try_cast("int").alias("month"), part("uf").alias("uf"))
    for c, wanted in (("year", years), ("month", months), ("uf", ufs)):
        out = out.where(F.col(c).isin(list(wanted))) if wanted else out
    return out


def read_catalog(spark: SparkSession, path: str, refresh: Callable[[], str] | None = None) -> DataFrame:
    """The municipality catalog, a JSON array. When the file holds none, ``refresh`` is asked for its path; else it raises."""
    try:
        df = spark.read.schema(CATALOG).option("multiLine", True).json(path)
        if not df.where("id IS NOT NULL").isEmpty():
            return df
    except Exception:
        if refresh is None:
            raise
    if refresh is None:
        raise ValueError("the catalog is empty")
    return read_catalog(spark, refresh())


def read_centres(spark: SparkSession, path: str) -> DataFrame:
    """(ibge_id, lat, lon) of a centroid cache; entries that aren't numbers are left out."""
    raw = spark.read.schema(CENTRES).option("multiLine", True).json(path).select(F.explode("centroids").alias("ibge_id", "c"))
    typed = raw.select("ibge_id", nz.number(F.col("c.lat")).alias("lat"), nz.number(F.col("c.lon")).alias("lon"))
    return typed.where("lat IS NOT NULL AND lon IS NOT NULL")


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(FACILITIES).option("multiLine", True).json(path).select(F.explode("facilities").alias("k", "f"))
    return raw.select(
        nz.facility_code(F.col("k")).alias("cnes"), F.col("f.name").alias("name"), nz.code6_loose(F.col("f.municipality_code")).alias("municipality_code"),
        nz.number(F.col("f.latitude")).alias("latitude"), nz.number(F.col("f.longitude")).alias("longitude"),
    ).where("cnes != ''")


def missing_keys(requested: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return requested.select(key).where(F.col(key).isNotNull()).distinct().join(cached.select(key), key, "left_anti")


def refresh_cache(requested: DataFrame, cached: DataFrame, key: str, fetch: Callable[[str], dict | None], limit: int = 10_000) -> DataFrame:
    """``cached`` plus what ``fetch`` gives for the requested keys it lacks. Entries that aren't requested stay.

    Fetching goes through the driver, one request a key, in blocks of ``limit`` keys until every missing key was asked for once.
    """
    spark = requested.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in cached.schema.fields])
    missing = cut(missing_keys(requested, cached, key))
    out, rest = cached, missing
    while keys := [r[0] for r in rest.orderBy(key).limit(limit).collect()]:
        rows = [r for k in keys if (r := fetch(k)) is not None]
        out = out.unionByName(cut(spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)))
        rest = missing.where(F.col(key) > F.lit(keys[-1]))
    return out


def facility_record(payload: DataFrame) -> DataFrame:
    """A facility service's answers as reference rows: trade name, else company name; coordinates only if numeric."""
    name = F.coalesce(F.nullif(nz.text(F.col("nome_fantasia")), F.lit("")), F.nullif(nz.text(F.col("nome_razao_social")), F.lit("")))
    return payload.select(
        nz.facility_code(F.col("codigo_cnes")).alias("cnes"), name.alias("name"), nz.code6_loose(F.col("codigo_municipio")).alias("municipality_code"),
        nz.number(F.col("latitude_estabelecimento_decimo_grau")).alias("latitude"), nz.number(F.col("longitude_estabelecimento_decimo_grau")).alias("longitude"),
    )


MAX_ATTRIBUTES = 200
NUMBERS = ("transfer_count", "confidence_score", "distance_km", "latitude", "longitude", "capacity_beds")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (node_id, label, attributes) and edges (source_node_id, target_node_id, weight, attributes) of a GEXF or GraphML file.

    Attributes get the names that the file declares for them (at most MAX_ATTRIBUTES a kind); counts, scores and coordinates are
    numbers, the rest text.
    """
    gexf = path.lower().endswith(".gexf")
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    item, name = ("struct<_for: string, _value: string>", "attvalues") if gexf else ("struct<_key: string, _VALUE: string>", "data")
    cells = f"attvalues struct<attvalue: array<{item}>>" if gexf else f"data array<{item}>"
    if gexf:
        declared = xml("attributes", "_class string, attribute array<struct<_id: string, _title: string>>").select(F.col("_class").alias("kind"), F.explode("attribute").alias("a")).select("kind", F.col("a._id").alias("id"), F.col("a._title").alias("title"))
    else:
        declared = xml("key", "_id string, _for string, `_attr.name` string").select(F.col("_for").alias("kind"), F.col("_id").alias("id"), F.col("`_attr.name`").alias("title"))
    titles: dict[str, dict[str, str]] = {"node": {}, "edge": {}}
    for r in declared.limit(2 * MAX_ATTRIBUTES + 1).collect():
        titles.setdefault(r.kind, {})[r.id] = r.title
    if any(len(t) > MAX_ATTRIBUTES for t in titles.values()):
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")

    def attributes(kind: str) -> list:
        pairs = F.col("attvalues.attvalue") if gexf else F.col("data")
        key, value = ("_for", "_value") if gexf else ("_key", "_VALUE")
        of = lambda i: F.element_at(F.filter(pairs, lambda p: p[key] == i), 1)[value]
        has = lambda i: F.exists(pairs, lambda p: p[key] == i)
        found = {i: F.when(has(i), of(i)) for i in titles[kind]}
        return [(c.try_cast("double") if titles[kind][i] in NUMBERS else c).alias(titles[kind][i]) for i, c in found.items()]

    v = xml("node", f"_id string, _label string, {cells}").select(F.col("_id").alias("node_id"), F.col("_label").alias("label"), *attributes("node"))
    e = xml("edge", f"_source string, _target string, _weight double, {cells}").select(F.col("_source").alias("source_node_id"), F.col("_target").alias("target_node_id"), F.col("_weight").alias("weight"), *attributes("edge"))
    return v, e


def read_geojson_centres(spark: SparkSession, path: str) -> DataFrame:
    """(path, lon, lat): the plain mean of the centroids of a file's features."""
    from ..functions.geometry import geometry_centroid

    poly = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    kind = F.from_json("value", "features array<struct<geometry: struct<type: string, coordinates: string>>>")
    f = raw.select("path", F.explode(kind["features"]).alias("f"))
    shape = f.select("path", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    typed = shape.select("path", "kind", F.when(F.col("kind") == "Polygon", F.from_json("c", poly)).alias("p"), F.when(F.col("kind") == "MultiPolygon", F.from_json("c", T.ArrayType(poly))).alias("m"))
    c = typed.select("path", geometry_centroid(F.col("kind"), F.col("p"), F.col("m")).alias("c")).where("c IS NOT NULL")
    return c.groupBy("path").agg(F.avg("c.lon").alias("lon"), F.avg("c.lat").alias("lat"))
