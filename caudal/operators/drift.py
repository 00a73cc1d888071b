"""Schemas that drift between the files of a stream.

Each file gets a fingerprint: its field names with the usual writing of their values. A file whose fingerprint differs from
the one before gets a new schema version and the migration steps that lead to it (added, removed, renamed, retyped); only such
files are compared with the one before.

The steps of a stream are chained into routes: which of its fields is meant by a name in which files, so a name that comes back
for something else is another field. Fields of several streams are one column if they share a name and a kind of content. Each
file's lines are read by the routes of that file: renames to the column's name, missing fields as null, values cast to its kind.

Line data stays in Spark throughout; of the schema only the columns of the result, whose number is checked, reach the driver.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import graph

#: A field that goes and one that comes are the same when their contents are at least so alike (0 to 1).
RENAME_LIKENESS = 0.6
#: More columns than this are no layout any more.
MAX_FIELDS = 5_000
FILE = ["stream_id", "file_id"]


def line_fields(raw: DataFrame, keep: list[str]) -> DataFrame:
    """One row per line and field: ``field``, ``is_number``, ``text`` (null for JSON null).

    A payload that isn't a JSON object (null, empty, broken, an array) or names a field twice has no fields.
    """
    doc = F.try_parse_json(F.col("payload"))
    rows = raw.where(F.schema_of_variant(doc).startswith("OBJECT")).select(*keep, doc.alias("_doc"))
    rows.createOrReplaceTempView(name := f"_drift_{abs(id(rows))}")
    spark = raw.sparkSession
    try:
        out = spark.sql(
            f"SELECT {', '.join(keep)}, f.key AS field, schema_of_variant(f.value) AS _type, CAST(f.value AS STRING) AS text "
            f"FROM {name}, LATERAL variant_explode(_doc) AS f"
        )
    finally:
        spark.catalog.dropTempView(name)
    number = F.col("_type").rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return out.withColumn("is_number", number & F.col("text").isNotNull()).drop("_type")


def writing(text: Column, is_number: Column) -> Column:
    """How a value is written."""
    return (
        F.when(is_number, "number")
        .when(text.rlike(r"^\d+$"), "digits")
        .when(text.rlike(r"^[-+]?\d+\.\d+$"), "decimal point")
        .when(text.rlike(r"^[-+]?\d+,\d+$"), "decimal comma")
        .when(text.rlike(r"^\d+(-\d+)+$"), "dashes")
        .when(text.rlike(r"^\d+(/\d+)+$"), "slashes")
        .when(text.rlike(r"^[\d./,-]+$"), "punctuation")
        .otherwise("text")
    )


def with_content(cells: DataFrame, kinds: bool = False) -> DataFrame:
    """Adds ``tokens``, what each value is whatever its writing: its shape, its kind if wanted, its leading part roughly and finely.

    Numbers of up to three digits have the shape ``int`` and lead with their size, in steps of five and exactly; longer ones
    have their number of digits and their first digit; decimals that they have a fraction; other texts runs of letters and digits in
    pattern, and their length. The steps are columns of their own, so that none is computed twice.
    """
    text, flat = F.col("text"), F.col("_flat")
    swap = F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{4})$", "$3$2$1")  # the writing of a day doesn't matter here
    iso = F.when(text.contains("/"), swap).otherwise(text)
    fraction = (text.contains(".") | text.contains(",")) & text.rlike(r"^[-+]?\d+[.,]\d{1,2}$")
    staged = cells.withColumn("_iso", iso).withColumn("_flat", F.translate("_iso", "-./,", "")).withColumn("_digits", flat.rlike(r"^\d+$"))
    staged = staged.withColumn("_size", F.when(F.col("_digits"), F.length("_flat"))).withColumn("_small", F.when(F.col("_size") <= 3, flat.cast("int")))
    runs = F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "9"), r"[^9\W]+", "a")
    pattern = F.concat(F.when(F.length(runs) > 40, F.sha1(runs)).otherwise(runs), F.lit(":"), F.length(text))
    shape = F.when(fraction, "s:decimal").when(F.col("_small").isNotNull(), "s:int").when(F.col("_digits"), F.concat(F.lit("s:d"), "_size")).otherwise(F.concat(F.lit("s:"), pattern))
    first = F.substring("_iso", 1, 1)
    rough = F.concat(F.lit("l:"), F.coalesce(F.floor(F.col("_small") / 5).cast("string"), first))
    fine = F.concat(F.lit("x:"), F.coalesce(F.col("_small").cast("string"), first))
    day = F.when(F.col("_digits") & (F.col("_size") == 8) & flat.rlike("^(19|20)"), F.try_to_timestamp("_flat", F.lit("yyyyMMdd"))).isNotNull()
    kind = F.when(day, "k:date").when(fraction, "k:decimal").when(F.col("is_number") | ~F.col("_digits"), "k:text").otherwise(F.concat(F.lit("k:"), F.col("_size").cast("string")))
    out = staged.withColumn("_shape", shape).withColumn("tokens", F.array(F.col("_shape"), *([kind] if kinds else []), rough, fine))
    return out.drop("_iso", "_flat", "_digits", "_size", "_small", "_shape")


def cell_counts(raw: DataFrame, kinds: bool = False) -> DataFrame:
    """(stream_id, file_id, field, token, n): how often each writing (``w:``), shape (``s:``), lead (``l:``, ``x:``) and kind occurs.

    Kinds (``k:``, which only ``unified`` needs) are date, decimal, the number of digits of a string, or text.

    The one pass over the payloads; everything about a file's schema follows from these counts, a few rows a field. A field
    that only holds nulls has the one token ``w:`` with the count 0.
    """
    text = F.col("text")
    cells = with_content(line_fields(raw, FILE), kinds)
    usual = F.array(F.concat(F.lit("w:"), writing(text, F.col("is_number"))))
    tokens = F.when(text.isNull(), F.array(F.lit("w:"))).otherwise(F.concat(usual, "tokens"))
    return cells.select(*FILE, "field", "text", F.explode(tokens).alias("token")).groupBy(*FILE, "field", "token").agg(F.count("text").alias("n"))


def file_fields(counts: DataFrame) -> DataFrame:
    """(stream_id, file_id, field, usual_writing): a field that only held nulls has no usual writing."""
    usual = F.max_by(F.substring("token", 3, 100), F.when(F.col("n") > 0, F.struct("n", "token")))
    return counts.where(F.col("token").startswith("w:")).groupBy(*FILE, "field").agg(usual.alias("usual_writing"))


def file_contents(counts: DataFrame) -> DataFrame:
    """(stream_id, file_id, field, token, share) of the non-null values, shapes twice; the shares of a field add up to 1."""
    n = F.when(F.col("token").startswith("s:"), 2 * F.col("n")).otherwise(F.col("n"))
    tokens = counts.where(F.substring("token", 1, 2).isin("s:", "l:", "x:")).withColumn("n", n)
    total = tokens.groupBy(*FILE, "field").agg(F.sum("n").alias("_all"))
    return tokens.join(total, [*FILE, "field"]).select(*FILE, "field", "token", (F.col("n") / F.col("_all")).alias("share"))


def _next(df: DataFrame) -> DataFrame:
    return df.withColumn("file_id", F.col("file_id") + 1)


def schema_changes(raw: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(stream_id, file_id, change_kind, field_name, prior_name, prior_writing, new_writing), one row per change.

    A file without the file before it in its stream has no changes. Repeated lines and the order of fields don't matter.
    ``counts``: ``cell_counts`` of ``raw``, if they are there already.
    """
    counts = cut(cell_counts(raw)) if counts is None else counts
    now = cut(file_fields(counts))
    prints = schema_versions(counts, now).select(*FILE, "fingerprint")
    # files of the same fingerprint as the one before have no changes
    paired = cut(prints.join(_next(prints).withColumnRenamed("fingerprint", "_before"), FILE).where("fingerprint != _before").select(*FILE))
    before = _next(now).join(paired, FILE, "left_semi")
    after = now.join(paired, FILE, "left_semi")
    both = after.withColumnRenamed("usual_writing", "new_writing").join(
        before.withColumnRenamed("usual_writing", "prior_writing").withColumn("_had", F.lit(True)), [*FILE, "field"], "full"
    ).join(after.select(*FILE, "field").withColumn("_has", F.lit(True)), [*FILE, "field"], "left")
    both = both.select(*FILE, "field", "new_writing", "prior_writing", F.col("_had").isNotNull().alias("had"), F.col("_has").isNotNull().alias("has"))
    both = cut(both.where((F.col("had") != F.col("has")) | (F.col("new_writing") != F.col("prior_writing"))))
    retyped = both.where(F.col("had") & F.col("has")).select(
        *FILE, F.lit("retyped").alias("change_kind"), F.col("field").alias("field_name"), F.lit("").alias("prior_name"), "prior_writing", "new_writing"
    )
    gone = both.where(F.col("had") & ~F.col("has")).select(*FILE, F.col("field").alias("gone"), "prior_writing")
    come = both.where(~F.col("had") & F.col("has")).select(*FILE, F.col("field").alias("come"), "new_writing")
    pairs = _renames(counts, gone, come)
    renamed = pairs.join(gone, [*FILE, "gone"]).join(come, [*FILE, "come"]).select(
        *FILE, F.lit("renamed").alias("change_kind"), F.col("come").alias("field_name"), F.col("gone").alias("prior_name"), "prior_writing", "new_writing"
    )
    none = F.lit(None).cast("string")
    added = come.join(pairs, [*FILE, "come"], "left_anti").select(
        *FILE, F.lit("added").alias("change_kind"), F.col("come").alias("field_name"), F.lit("").alias("prior_name"), none.alias("prior_writing"), "new_writing"
    )
    removed = gone.join(pairs, [*FILE, "gone"], "left_anti").select(
        *FILE, F.lit("removed").alias("change_kind"), F.col("gone").alias("field_name"), F.lit("").alias("prior_name"), "prior_writing", none.alias("new_writing")
    )
    return renamed.unionByName(added).unionByName(removed).unionByName(retyped)


def _renames(counts: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """Pairs of a gone and a come field of one file, best likeness first, each field in one pair at most.

    Pairs are formed within a file only, among the fields that changed there. A pair is taken when it is the best of both its
    fields; the rest is looked at again without them, until no pair is left, so the result is that of a greedy choice.
    """
    contents = file_contents(counts)
    a = _next(contents).withColumnRenamed("field", "gone").withColumnRenamed("share", "share_a").join(gone, [*FILE, "gone"], "left_semi")
    b = contents.withColumnRenamed("field", "come").withColumnRenamed("share", "share_b").join(come, [*FILE, "come"], "left_semi")
    # each value has one shape and one lead token, so the shares of a field add up to 1
    likeness = a.join(b, [*FILE, "token"]).groupBy(*FILE, "gone", "come").agg(F.sum(F.least("share_a", "share_b")).alias("likeness"))
    alike = likeness.where(F.col("likeness") >= RENAME_LIKENESS)
    score = F.struct(
        F.col("likeness"),
        (-F.levenshtein(F.lower("gone"), F.lower("come"))).alias("name"),
        F.col("gone"),
        F.col("come"),
    )
    open_pairs = cut(alike.withColumn("score", score))
    taken: list[DataFrame] = []
    while not open_pairs.isEmpty():
        best = open_pairs.withColumn("_g", F.max("score").over(Window.partitionBy(*FILE, "gone"))).withColumn(
            "_c", F.max("score").over(Window.partitionBy(*FILE, "come"))
        )
        won = cut(best.where((F.col("score") == F.col("_g")) & (F.col("score") == F.col("_c"))).select(*FILE, "gone", "come"))
        taken.append(won)
        open_pairs = cut(
            open_pairs.join(won.select(*FILE, "gone"), [*FILE, "gone"], "left_anti").join(won.select(*FILE, "come"), [*FILE, "come"], "left_anti")
        )
    out = open_pairs.select(*FILE, "gone", "come")
    for t in taken:
        out = out.unionByName(t)
    return out


def schema_versions(counts: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """From ``cell_counts``: (stream_id, file_id, fingerprint, schema_version, n_fields): the version rises by 1 when the fingerprint changes."""
    fields = file_fields(counts) if fields is None else fields
    layout = F.array_sort(F.collect_list(F.concat_ws("=", "field", F.coalesce("usual_writing", F.lit("null")))))
    prints = fields.groupBy(*FILE).agg(F.sha1(F.concat_ws("\n", layout)).alias("fingerprint"), F.count(F.lit(1)).alias("n_fields"))
    w = Window.partitionBy("stream_id").orderBy("file_id")
    changed = F.when(F.lag("fingerprint").over(w).eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    return prints.withColumn("_c", changed).withColumn("schema_version", F.sum("_c").over(w)).drop("_c")


def _walk(key: tuple, steps: pd.DataFrame) -> pd.DataFrame:
    """The routes of one stream: its steps in the order of its files."""
    spans: list[list] = []
    live: dict[str, list] = {}
    known: dict[str, str] = {}

    def open_(name: str, lineage: str | None, file: int) -> None:
        if lineage is None or any(s[1] == lineage for s in live.values()):
            lineage = f"{name}@{file}"
        known[name] = lineage
        live[name] = [name, lineage, file, None]
        spans.append(live[name])

    def close(name: str, file: int) -> str | None:
        if name not in live:
            return None
        span = live.pop(name)
        span[3] = file
        return span[1]

    table = sorted(zip(steps["file_id"], steps["kind"], steps["field"], steps["prior"]))
    for file, of_file in groupby(table, key=lambda r: r[0]):
        rows = [r[1:] for r in of_file]
        if any(k == "start" for k, _, _ in rows):
            for name in list(live):
                close(name, file)
        moved = {f: close(p, file) for k, f, p in rows if k == "renamed"}
        for k, f, _ in rows:
            if k == "removed":
                close(f, file)
        for f, lineage in moved.items():
            open_(f, lineage, file)
        for k, f, _ in rows:
            if k in ("start", "added"):
                open_(f, known.get(f), file)
    return pd.DataFrame([(key[0], *s) for s in spans], columns=["stream_id", "field", "lineage", "from_file", "to_file"]).astype({"from_file": "int64", "to_file": "Int64"})


def routes(counts: DataFrame, changes: DataFrame, fields: DataFrame) -> DataFrame:
    """(stream_id, field, lineage, from_file, to_file): which field of a stream a name means, from a file up to before another.

    The steps of each stream are chained on their own, a few rows a file that changed. A file without the one before it starts
    anew: names known in the stream go on with what they meant.
    """
    files = fields.select(*FILE).distinct()
    starts = fields.join(files.join(_next(files), FILE, "left_anti"), FILE, "left_semi")
    steps = starts.select(*FILE, F.lit("start").alias("kind"), "field", F.lit("").alias("prior")).unionByName(
        changes.where("change_kind != 'retyped'").select(*FILE, F.col("change_kind").alias("kind"), F.col("field_name").alias("field"), F.col("prior_name").alias("prior"))
    )
    typed = steps.select(F.col("stream_id").cast("long"), F.col("file_id").cast("long"), "kind", "field", "prior")
    return typed.groupBy("stream_id").applyInPandas(_walk, "stream_id long, field string, lineage string, from_file long, to_file long")


def layout(counts: DataFrame, changes: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(stream_id, file_id, field, lineage, column) for every field of every file, and the kinds of the columns.

    Lineages are one column if they share a name and a kind; where that would give two fields of a file one column, their
    lineages keep to their own usual names instead, told apart by a number. A column is named after its most frequent name,
    with its kind if another column has that name, too.
    """
    fields = cut(file_fields(counts).select(*FILE, "field"))
    spans = routes(counts, changes, fields)
    inside = (F.col("file_id") >= F.col("from_file")) & (F.col("to_file").isNull() | (F.col("file_id") < F.col("to_file")))
    placed = cut(fields.join(spans, ["stream_id", "field"]).where(inside).select(*FILE, "field", "lineage"))
    of_kind = counts.where(F.col("token").startswith("k:") & (F.col("n") > 0)).join(placed, [*FILE, "field"]).groupBy("stream_id", "lineage", F.substring("token", 3, 20).alias("k")).agg(F.sum("n").alias("n"))
    total, part = F.sum("n"), lambda k: F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0))
    kinds = of_kind.groupBy("stream_id", "lineage").agg(F.when(2 * part("date") > total, "date").when(2 * part("decimal") > total, "double").otherwise("string").alias("kind"))
    used = placed.groupBy("stream_id", "lineage", "field").agg(F.count(F.lit(1)).alias("n"))
    own = used.groupBy("stream_id", "lineage").agg(F.max_by("field", F.struct("n", "field")).alias("own_name"))
    # a field that only ever held nulls goes with whatever has its name
    named = used.join(kinds, ["stream_id", "lineage"], "left").join(own, ["stream_id", "lineage"])
    named = cut(named.withColumn("node", F.when(F.col("kind").isNotNull(), F.concat_ws(":", "kind", "field"))).withColumn("hub", F.concat_ws(":", "kind", "own_name")))
    links = named.where("kind IS NOT NULL AND node != hub").select(F.col("node").alias(graph.S), F.col("hub").alias(graph.T)).distinct()
    vertices = named.where("kind IS NOT NULL").select(F.col("node").alias("node_id"))
    parts = graph.weak_components(vertices, links).withColumnRenamed("node_id", "hub")
    grouped = named.where("node = hub OR kind IS NULL").join(parts, "hub", "left").select("stream_id", "lineage", "kind", "own_name", "component")
    crowded = placed.join(grouped.where("component IS NOT NULL"), ["stream_id", "lineage"]).groupBy(*FILE, "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component").distinct().withColumn("_crowded", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("stream_id", "kind", "own_name").orderBy("lineage"))
    grouped = grouped.join(crowded, "component", "left").withColumn("nth", nth)
    alone = F.concat_ws(":", F.lit("own"), "kind", "own_name", F.when(F.col("nth") > 1, F.col("nth").cast("string")))
    grouped = cut(grouped.withColumn("group", F.when(F.col("_crowded"), alone).otherwise(F.col("component"))))
    weights = used.join(grouped, ["stream_id", "lineage"]).where("group IS NOT NULL").groupBy("group", "kind", F.when(F.col("_crowded"), F.col("own_name")).otherwise(F.col("field")).alias("name"), F.when(F.col("_crowded"), F.col("nth")).otherwise(1).alias("nth")).agg(F.sum("n").alias("n"))
    best = weights.groupBy("group", "kind").agg(F.max_by(F.struct("name", "nth"), F.struct("n", "name")).alias("_b"), F.sum("n").alias("n"))
    order = Window.partitionBy("_b.name").orderBy(F.desc("n"), "group")
    titled = best.withColumn("_r", F.row_number().over(order)).withColumn("column", F.when(F.col("_r") == 1, F.col("_b.name")).otherwise(F.concat_ws(":", "_b.name", "kind", F.when(F.col("_r") > 2, F.col("_r").cast("string")))))
    titled = cut(titled.select("group", "kind", "column"))
    rows = titled.select("column", "kind").limit(MAX_FIELDS + 1).collect()
    if len(rows) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} columns")
    of_lineage = grouped.where("group IS NOT NULL").select("stream_id", "lineage", "group").distinct().join(titled.select("group", "column"), "group").drop("group")
    return placed.join(of_lineage, ["stream_id", "lineage"], "left"), {r.column: r.kind for r in rows}


def unified(raw: DataFrame, changes: DataFrame, keys: list[str], counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All lines as one table: ``keys``, ``schema_version``, one column per field, cast to its kind, and ``unread``; and the layout.

    The kinds are date (8 digits in any writing), decimal, and text; a number in a text column that usually holds strings of
    one width gets its lost leading zeros back, and only its digits stay. A value that doesn't fit its column's kind is null there and stays in
    ``unread`` as field=text. A payload that is no JSON object, or names a field twice, is in ``unread`` as it is; a null or
    empty one leaves it empty. Repeated lines stay repeated. A column whose name is one of ``keys`` gets its kind appended.
    ``counts``: ``cell_counts`` of ``raw`` with kinds, if they are there already.
    """
    counts = cut(cell_counts(raw, True)) if counts is None else counts
    placed, kinds = layout(counts, changes)
    placed = cut(placed)
    widths = counts.where(F.col("token").rlike(r"^k:\d+$")).join(placed.where("column IS NOT NULL"), [*FILE, "field"]).groupBy("column", F.substring("token", 3, 20).cast("int").alias("w")).agg(F.sum("n").alias("n"))
    width = {r.column: r.w for r in widths.groupBy("column").agg(F.max_by("w", F.struct("n", "w")).alias("w")).collect()}  # one row a column
    versions = schema_versions(counts).select(*FILE, "schema_version")
    entry = F.struct(F.col("column").alias("key"), F.col("field").alias("value"))
    per_file = placed.where("column IS NOT NULL").groupBy(*FILE).agg(F.map_from_entries(F.collect_list(entry)).alias("_route"))
    per_file = cut(versions.join(per_file, FILE, "left"))
    doc = F.try_parse_json(F.col("payload"))
    lines = raw.select(*keys, *[c for c in FILE if c not in keys], "payload").withColumn("_doc", doc)
    lines = lines.withColumn("_cells", F.when(F.schema_of_variant("_doc").startswith("OBJECT"), F.col("_doc").cast("map<string,string>")))
    lines = lines.join(per_file, FILE, "left")
    values, unread = [], [F.when(F.col("_cells").isNull() & (F.length(F.trim("payload")) > 0), F.col("payload"))]
    taken = {c.lower() for c in (*keys, *FILE, "schema_version", "unread")}
    stages: dict[str, Column] = {}
    for k, (column, kind) in enumerate(sorted(kinds.items())):
        field = F.try_element_at("_route", F.lit(column))
        stages[f"_t{k}"] = F.try_element_at("_cells", field)
        text = F.col(f"_t{k}")
        flat = F.translate(text, "-./", "")
        if kind == "date":
            iso = F.when(text.contains("/"), F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{4})$", "$3$2$1")).otherwise(text)
            iso = F.translate(iso, "-./", "")
            value = F.when(iso.rlike(r"^(19|20)\d{6}$"), F.try_to_timestamp(iso, F.lit("yyyyMMdd")).cast("date"))
        elif kind == "double":
            value = F.translate(text, ",", ".").try_cast("double")
        else:
            w = width.get(column) or 0
            value = F.when(flat.rlike(r"^\d+$"), F.when(F.length(flat) < w, F.lpad(flat, w, "0")).otherwise(flat)).otherwise(text) if w else text
        name = column
        while name.lower() in taken:
            name = f"{name}:{kind}"
        taken.add(name.lower()) if name.lower() not in {c.lower() for c in kinds} else None
        values.append(value.alias(name))
        if kind != "string":
            unread.append(F.when(text.isNotNull() & value.isNull(), F.concat_ws("=", field, text)))
    wide = lines.withColumns(stages) if stages else lines
    return wide.select(*keys, "schema_version", *values, F.array_sort(F.array_compact(F.array(*unread))).alias("unread")), placed
