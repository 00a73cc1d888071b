"""Filling nodes from municipality catalogs and facility references, and building those references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz
from .nodes import keep_first

# Fixed value: the centre used when no municipality has coordinates.
COUNTRY_CENTRE = (-15.793889, -47.882778)


def catalog_rows(catalog: DataFrame) -> DataFrame:
    """A nested catalog (id, nome, microrregiao.mesorregiao.UF.sigla) as ibge_id, name, state, code6. Levels may be null."""
    ibge = nz.municipality(F.col("id").cast("string"))
    flat = catalog.select(ibge.alias("ibge_id"), nz.text(F.col("nome")).alias("m_name"), nz.text(F.col("microrregiao.mesorregiao.UF.sigla")).alias("m_state"))
    return flat.where(F.length("ibge_id") == 7).withColumn("code6", F.substring("ibge_id", 1, 6))


def catalog_codes(catalog: DataFrame, digits: int) -> DataFrame:
    if digits not in (6, 7):
        raise ValueError("codes have 6 or 7 digits")
    return catalog_rows(catalog).select(F.substring("ibge_id", 1, digits).alias("code")).distinct()


def resolve(df: DataFrame, code: str, catalog: DataFrame) -> DataFrame:
    """Adds ibge_id, m_name and m_state for codes of 7 or 6 digits; of catalog entries sharing 6 digits the smallest id counts."""
    flat = catalog_rows(catalog)
    by7 = keep_first(flat, "ibge_id", ["m_name"]).select(F.col("ibge_id").alias("_k7"), F.struct("ibge_id", "m_name", "m_state").alias("_m7"))
    by6 = keep_first(flat, "code6", ["ibge_id", "m_name"]).select(F.col("code6").alias("_k6"), F.struct("ibge_id", "m_name", "m_state").alias("_m6"))
    c = nz.municipality(F.col(code))
    out = df.withColumn("_c7", F.when(F.length(c) == 7, c)).withColumn("_c6", F.when(F.length(c) == 6, c))
    out = out.join(by7, F.col("_c7") == F.col("_k7"), "left").join(by6, F.col("_c6") == F.col("_k6"), "left")
    m = F.coalesce("_m7", "_m6")
    return out.withColumns({"ibge_id": m["ibge_id"], "m_name": m["m_name"], "m_state": m["m_state"]}).drop("_c7", "_c6", "_k7", "_k6", "_m7", "_m6")


def codes_to_ids(codes: DataFrame, code: str, catalog: DataFrame) -> DataFrame:
    return resolve(codes, code, catalog).where(F.col("ibge_id").isNotNull()).select("ibge_id").distinct()


def enrich_municipalities(nodes: DataFrame, catalog: DataFrame, centres: DataFrame, assign_facilities: bool = True) -> DataFrame:
    """Fills blank names from the catalog and missing coordinates from ``centres`` (ibge_id, lat, lon).

    Coordinates are filled as a pair when either is null. A facility gets them only if its name was blank too.
    """
    c = keep_first(centres, "ibge_id", ["lat", "lon"]).select(F.col("ibge_id").alias("_cid"), "lat", "lon")
    found = resolve(nodes, "municipality_code", catalog).join(c, F.col("ibge_id") == F.col("_cid"), "left")
    kind, blank = F.lower("node_type"), nz.text(F.col("name")) == ""
    is_m, is_f, known = kind == "municipality", kind == "facility", F.col("ibge_id").isNotNull()
    name = (
        F.when(is_m & blank & known, nz.municipality_label(F.col("m_name"), F.col("m_state")))
        .when(is_f & blank, nz.facility_label(nz.facility_of_node(F.col("node_id")), F.col("m_name"), F.col("m_state")))
        .otherwise(F.col("name"))
    )
    gap = (F.col("latitude").isNull() | F.col("longitude").isNull()) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    fill = gap & ((is_m & known) | (is_f & blank & F.lit(assign_facilities)))
    return found.withColumns({
        "name": name, "latitude": F.when(fill, F.col("lat")).otherwise(F.col("latitude")), "longitude": F.when(fill, F.col("lon")).otherwise(F.col("longitude")),
        "_resolved": known,
    }).drop("lat", "lon", "_cid", "m_name", "m_state", "ibge_id")


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    """The seven counters of ``enrich_municipalities``."""
    kind = F.lower("node_type")
    m, f, geo = kind == "municipality", kind == "facility", F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    named = nz.text(F.col("name")) != ""
    return enriched.agg(
        F.count_if(m).alias("municipality_nodes_total"), F.count_if(m & F.col("_resolved")).alias("municipality_nodes_enriched"),
        F.count_if(m & geo).alias("municipality_nodes_with_coordinates"), F.count_if(f).alias("facility_nodes_total"),
        F.count_if(f & named).alias("facility_nodes_named"), F.count_if(f & geo).alias("facility_nodes_with_coordinates"),
        F.count_if(m & ~F.col("_resolved")).alias("missing_municipality_metadata"),
    )


def enrich_facilities(nodes: DataFrame, reference: DataFrame, key: str = "cnes", columns: dict[str, str] | None = None) -> tuple[DataFrame, Column]:
    """Overwrites facility cells with non-blank reference cells; also gives the expression that counts the changed cells of a row.

    ``columns``: node column to reference column. Columns the reference lacks are left alone and not counted.
    """
    columns = columns or {c: c for c in ("name", "municipality_code", "latitude", "longitude", "capacity_beds", "habilitation_level")}
    columns = {n: r for n, r in columns.items() if r in reference.columns and n in nodes.columns}
    ref = keep_first(reference.withColumn("_k", nz.text(F.col(key))), "_k", [F.col(r).asc_nulls_last() for r in columns.values()] or ["_k"])
    ref = ref.select("_k", *[F.col(r).alias(f"_r_{n}") for n, r in columns.items()])
    joined = nodes.join(ref, (F.lower("node_type") == "facility") & (nz.facility_of_node(F.col("node_id")) == F.col("_k")), "left")
    has = {n: F.col("_k").isNotNull() & F.col(f"_r_{n}").isNotNull() & (nz.text(F.col(f"_r_{n}")) != "") for n in columns}
    changed = sum((c.cast("int") for c in has.values()), F.lit(0))
    types = dict(nodes.dtypes)
    out = joined.withColumn("_cells", changed).withColumns({n: F.when(c, F.col(f"_r_{n}").try_cast(types[n])).otherwise(F.col(n)) for n, c in has.items()})
    return out.drop("_k", *[f"_r_{n}" for n in columns]), F.col("_cells")


def municipality_reference(catalog: DataFrame, centres: DataFrame) -> DataFrame:
    """Every municipality with coordinates: its own, else the mean of its state, else of the country, else a fixed centre."""
    c = centres.select(F.col("ibge_id").alias("_cid"), "lat", "lon")
    own = catalog_rows(catalog).join(c, F.col("ibge_id") == F.col("_cid"), "left")
    pair = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    of_state = own.where(pair).groupBy(F.col("m_state").alias("_s")).agg(F.avg("lat").alias("_slat"), F.avg("lon").alias("_slon"))
    of_all = [own.agg(F.avg(F.when(pair, F.col(c)))).scalar().alias(f"_n{c}") for c in ("lat", "lon")]
    every = own.join(of_state, F.col("m_state") == F.col("_s"), "left").select("*", *of_all)
    return every.select(
        "ibge_id", F.col("code6").alias("municipality_code"), F.col("m_name").alias("municipality_name"), F.col("m_state").alias("uf"),
        F.when(pair, F.col("lat")).otherwise(F.coalesce("_slat", "_nlat", F.lit(COUNTRY_CENTRE[0]))).alias("latitude"),
        F.when(pair, F.col("lon")).otherwise(F.coalesce("_slon", "_nlon", F.lit(COUNTRY_CENTRE[1]))).alias("longitude"),
        F.when(pair, "ibge_malha").when(F.col("_slat").isNotNull(), "uf_mean_fallback").otherwise("national_mean_fallback").alias("coordinate_source"),
    )


def facility_reference(facilities: DataFrame, municipalities: DataFrame, cache: DataFrame, competence: str) -> DataFrame:
    """Facilities (cnes, municipality_code, uf, ...) with municipality, name and coordinates; the cache's pair of coordinates wins."""
    m = keep_first(municipalities, "municipality_code", ["ibge_id"]).select(
        F.col("municipality_code").alias("_mc"), F.col("ibge_id").alias("_mid"), "municipality_name", F.col("uf").alias("_muf"),
        F.col("latitude").alias("_mlat"), F.col("longitude").alias("_mlon"), F.col("coordinate_source").alias("_msrc"),
    )
    a = keep_first(cache.withColumn("_k", nz.text(F.col("cnes"))), "_k", [F.col("name").asc_nulls_last()]).select(
        "_k", F.col("name").alias("_aname"), F.col("latitude").cast("double").alias("_alat"), F.col("longitude").cast("double").alias("_alon")
    )
    j = facilities.join(m, F.col("municipality_code") == F.col("_mc"), "left").join(a, F.col("cnes") == F.col("_k"), "left")
    own_state = F.upper(nz.text(F.col("uf")))
    state = F.when(own_state != "", own_state).otherwise(F.upper(nz.text(F.col("_muf"))))
    name, pair = nz.text(F.col("_aname")), F.col("_alat").isNotNull() & F.col("_alon").isNotNull()
    synthetic = F.concat(F.lit("CNES "), "cnes", F.lit(" ("), F.coalesce("municipality_name", F.lit("")), F.lit(" - "), state, F.lit(")"))
    return j.select(
        "cnes", F.lit(competence).alias("competence"), F.col("_mid").alias("ibge_id"), "municipality_code", "municipality_name", state.alias("uf"),
        F.when(name != "", name).otherwise(synthetic).alias("name"),
        F.when(pair, F.col("_alat")).otherwise(F.col("_mlat")).alias("latitude"), F.when(pair, F.col("_alon")).otherwise(F.col("_mlon")).alias("longitude"),
        F.when(pair, "cnes_api").otherwise(F.coalesce("_msrc", F.lit("missing"))).alias("coordinate_source"),
        F.when(name != "", "cnes_api").otherwise("synthetic_municipality").alias("name_source"),
    )


def public_hospital(df: DataFrame) -> Column:
    """From the column of that name or from the raw flags; raises if neither is there."""
    if "is_public_hospital" in df.columns:
        return nz.truthy_batch(F.col("is_public_hospital"))
    if not {"vinc_sus", "atendhos", "leithosp", "niv_dep"} <= set(df.columns):
        raise ValueError("public hospitals can't be told from these columns")
    if "is_public_admin" in df.columns:
        public = nz.truthy_batch(F.col("is_public_admin"))
    else:
        public = (nz.text(F.col("niv_dep")) == "1") | (nz.digits(F.col("nat_jur")).startswith("1") if "nat_jur" in df.columns else F.lit(False))
    return nz.truthy_batch(F.col("vinc_sus")) & (nz.truthy_batch(F.col("atendhos")) | nz.truthy_batch(F.col("leithosp"))) & public


def in_scope(df: DataFrame, scope: str) -> DataFrame:
    if scope not in ("all", "public_hospitals"):
        raise ValueError(f"unknown scope {scope}")
    return df if scope == "all" else df.where(public_hospital(df))


def reference_counters(reference: DataFrame) -> DataFrame:
    by = [F.count_if(F.col("coordinate_source") == s).alias(f"n_{s}") for s in ("cnes_api", "ibge_malha", "uf_mean_fallback", "national_mean_fallback", "missing")]
    return reference.agg(F.count(F.lit(1)).alias("n_facilities"), F.count_if(F.col("name_source") == "cnes_api").alias("n_named"), *by)
