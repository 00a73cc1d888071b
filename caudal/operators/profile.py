"""Column profiles derived from maintained value-count tables.

The store holds one row per (load, column, value) with a signed count. A load is a delta of +1 per value; a correction or
withdrawal is a delta with -1. A delivery appends its deltas and touches nothing else. All metrics (null rate, distinct values,
range, malformed values, top share, entropy) are exact and come from the counts alone. Each distinct value is judged once; the
rows that hold a malformed one are found by joining those values back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields


@dataclass(frozen=True)
class Rule:
    """``parsed`` gives null for malformed values; ``alternative`` tells the second well-formed writing; ``region`` a class.

    ``numeric``: parsed values are ordered as numbers, else as text (which is right for days and moments).
    """

    parsed: Callable[[Column], Column]
    alternative: Callable[[Column], Column] | None = None
    region: Callable[[Column], Column] | None = None
    numeric: bool = False


RULES: dict[str, Rule] = {
    "munic_res": Rule(fields.municipality6, lambda v: F.length(F.trim(v)) == 7, lambda v: F.substring(F.trim(v), 1, 2)),
    "nasc": Rule(fields.birth_day, lambda v: F.trim(v).contains("-")),
    "dt_inter": Rule(fields.entry_moment, lambda v: ~F.trim(v).contains("-")),
    "cgc_hosp": Rule(fields.tax_number, lambda v: F.trim(v).contains("/")),
}

#: Rules of all columns of stays but ``feed``, whose names are free.
ALL_RULES: dict[str, Rule] = RULES | {
    "cmpt": Rule(lambda v: fields.matching(v, r"^\d{4}(0[1-9]|1[0-2])$")),
    "cnes": Rule(lambda v: fields.matching(v, r"^\d{7}$")),
    "n_aih": Rule(lambda v: fields.matching(v, r"^(?!(\d)\1*$)\d{13}$")),
    "cep": Rule(lambda v: fields.matching(v, r"^(?!(\d)\1*$)\d{8}$")),
    "sexo": Rule(lambda v: fields.matching(v, r"^[13]$")),
    "idade": Rule(lambda v: fields.whole_number(v, 130), numeric=True),
    "dt_saida": Rule(fields.entry_moment, lambda v: ~F.trim(v).contains("-")),
    "diag_princ": Rule(lambda v: fields.matching(v, r"^[A-Z]\d{2,3}$")),
    "cobranca": Rule(lambda v: fields.matching(v, r"^\d{2}$")),
    "dias_perm": Rule(lambda v: fields.whole_number(v, 9999), numeric=True),
    "marca_uti": Rule(lambda v: fields.matching(v, r"^\d{2}$")),
    "proc_rea": Rule(lambda v: fields.matching(v, r"^\d{10}$")),
    "val_tot": Rule(fields.amount, lambda v: F.trim(v).contains(","), numeric=True),
    "raca_cor": Rule(lambda v: fields.matching(v, r"^(0[1-5]|99)$")),
    "arrived_at": Rule(lambda v: v.try_cast("timestamp_ntz")),
    "stay_id": Rule(lambda v: v.try_cast("long"), numeric=True),
}

NULL_CHANGE, TOP_CHANGE, FORM_CHANGE, REGION_CHANGE = 0.10, 0.15, 0.30, 0.40
KEYS = ["load_id", "column_name"]


def unpivot(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(*keep, F.explode(cells).alias("_cell")).select(*keep, "_cell.column_name", "_cell.value")


def value_deltas(rows: DataFrame, columns: Sequence[str], load: str = "load_id", sign: int = 1) -> DataFrame:
    """The signed value counts of ``rows``; values without outer spaces, all blanks as null."""
    cells = unpivot(rows.withColumnRenamed(load, "load_id") if load != "load_id" else rows, columns, ["load_id"])
    return cells.groupBy(*KEYS, fields.trimmed(F.col("value")).alias("value")).agg(F.sum(F.lit(sign)).cast("long").alias("n"))


def apply_deltas(store: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The store after ``deltas``; values whose count becomes 0 leave it."""
    if store is None:
        return deltas
    both = store.unionByName(deltas).groupBy(*KEYS, "value").agg(F.sum("n").alias("n"))
    return both.where(F.col("n") != 0)


class ValueStore:
    """Value counts kept under a folder that all executors share, a layer per delivery.

    ``apply`` costs as much as its delivery; one that is applied again under its name replaces itself. ``compact`` adds the layers up.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.deliveries: list[str] = []

    def apply(self, deltas: DataFrame, delivery: str) -> None:
        deltas.select(*KEYS, "value", "n").write.mode("overwrite").parquet(f"{self.path}/{delivery}")
        if delivery not in self.deliveries:
            self.deliveries.append(delivery)

    def counts(self) -> DataFrame:
        """(load_id, column_name, value, n) after all deliveries; values whose count became 0 are gone."""
        schema = "load_id long, column_name string, value string, n long"
        store = None
        for d in self.deliveries:
            layer = self.spark.read.schema(schema).parquet(f"{self.path}/{d}")
            store = apply_deltas(store, layer)
        return self.spark.createDataFrame([], schema) if store is None else store

    def compact(self) -> None:
        if len(self.deliveries) > 1:
            name = f"{self.deliveries[-1]}-all"
            self.counts().write.mode("overwrite").parquet(f"{self.path}/{name}")
            self.deliveries = [name]


def _by_column(rules: dict[str, Rule], pick: Callable[[Rule], Column | None], default: Column) -> Column:
    out = None
    for name, rule in rules.items():
        value = pick(rule)
        if value is not None:
            out = (F if out is None else out).when(F.col("column_name") == name, value)
    return default if out is None else out.otherwise(default)


def judged(counts: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Adds ``well`` (null when blank, or without a rule), ``alt`` and ``region`` to each value of the store."""
    v = F.col("value")
    known = F.col("column_name").isin(*rules) if rules else F.lit(False)
    well = F.when(v.isNotNull() & known, _by_column(rules, lambda r: r.parsed(v).isNotNull(), F.lit(True)))
    out = counts.withColumn("well", well)
    out = out.withColumn("alt", F.col("well") & _by_column(rules, lambda r: r.alternative(v) if r.alternative else None, F.lit(False)))
    return out.withColumn("region", F.when(F.col("well"), _by_column(rules, lambda r: r.region(v) if r.region else None, F.lit(None).cast("string"))))


def _metrics(values: DataFrame, *more: Column) -> DataFrame:
    n, filled = F.col("n"), F.col("value").isNotNull()
    some = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    agg = values.groupBy(*KEYS).agg(
        F.sum("n").alias("n_rows"),
        some(~filled).alias("n_blank"),
        F.count(F.when(filled, 1)).alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        some(F.col("well") == F.lit(False)).alias("n_bad"),
        some(F.col("well")).alias("n_well"),
        some(F.col("alt")).alias("n_alt"),
        F.coalesce(F.max(F.when(filled, n)), F.lit(0)).cast("long").alias("n_top"),
        F.sum(F.when(filled, n * F.log2(n.cast("double")))).alias("_nlogn"),
        *more,
    )
    total = F.col("n_rows") - F.col("n_blank")
    entropy = F.when(total > 0, F.log2(total.cast("double")) - F.coalesce(F.col("_nlogn"), F.lit(0.0)) / total).otherwise(F.lit(0.0))
    return agg.withColumn("entropy", F.round(F.greatest(entropy, F.lit(0.0)), 6)).drop("_nlogn")


def load_profile(counts: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """One row per load and column. ``entropy`` is in bits over the non-blank values; ranges compare values as strings.

    ``n_bad``, ``n_well`` and ``n_alt`` are null for a column without a rule.
    """
    rules = RULES if rules is None else rules
    known = F.col("column_name").isin(*rules) if rules else F.lit(False)
    return _metrics(judged(counts, rules)).withColumns({c: F.when(known, F.col(c)) for c in ("n_bad", "n_well", "n_alt")})


def full_profile(counts: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """``load_profile`` with ranges of what the values mean.

    Numbers too long for a double are told apart by their text. ``low`` and ``high`` are the range of the well-formed values (without a rule, of all) whatever their writing: numbers by size,
    days and moments by time, the rest as text.
    """
    rules = ALL_RULES if rules is None else rules
    v = F.col("value")
    known = F.col("column_name").isin(*rules) if rules else F.lit(False)
    # each value is parsed once; what follows is taken from its text
    values = counts.withColumn("_text", _by_column(rules, lambda r: r.parsed(v).cast("string"), v))
    values = values.withColumn("well", F.when(v.isNotNull() & known, F.col("_text").isNotNull()))
    values = values.withColumn("alt", F.col("well") & _by_column(rules, lambda r: r.alternative(v) if r.alternative else None, F.lit(False)))
    numeric = [c for c, r in rules.items() if r.numeric]
    size = F.when(F.col("column_name").isin(*numeric), F.col("_text").cast("double")) if numeric else F.lit(None).cast("double")
    values = values.withColumn("_at", F.when(F.col("_text").isNotNull(), F.struct(size.alias("size"), F.col("_text").alias("text"))))
    p = _metrics(values, F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    p = p.withColumns({c: F.when(known, F.col(c)) for c in ("n_bad", "n_well", "n_alt")})
    return p.withColumns({"low": F.col("_low.text"), "high": F.col("_high.text")}).drop("_low", "_high")


def region_shares(counts: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Half the sum of the absolute differences of the region shares of a load and the load before it."""
    regional = {k: r for k, r in rules.items() if r.region}
    if not regional:
        regional = {"": Rule(lambda v: v, lambda v: F.lit(False), lambda v: v)}
    per = (
        judged(counts.where(F.col("column_name").isin(*regional)), regional)
        .where(F.col("region").isNotNull())
        .groupBy(*KEYS, "region")
        .agg(F.sum("n").alias("n"))
    )
    of_load = per.groupBy(*KEYS).agg(F.sum("n").alias("_total"))
    share = per.join(of_load, KEYS).select(*KEYS, "region", (F.col("n") / F.col("_total")).alias("share"))
    after = share.withColumn("signed", F.col("share"))
    before = share.withColumn("load_id", F.col("load_id") + 1).withColumn("signed", -F.col("share"))
    diff = after.unionByName(before).groupBy(*KEYS, "region").agg(F.abs(F.sum("signed")).alias("d"))
    halves = diff.groupBy(*KEYS).agg((F.sum("d") / 2).alias("region_distance"))
    both = of_load.select(*KEYS).join(of_load.select((F.col("load_id") + 1).alias("load_id"), "column_name"), KEYS, "left_semi")
    return halves.join(both, KEYS, "left_semi")


def load_changes(counts: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """(load_id, column_name, finding) wherever a column changed against the load before. Shares are compared with 1e-9 slack."""
    rules = RULES if rules is None else rules
    # only columns with a second writing can change their form; the values of the others needn't be judged
    p = load_profile(counts, {c: r for c, r in rules.items() if r.alternative})
    a = p.select(*KEYS, "n_rows", "n_blank", "n_top", "n_well", "n_alt")
    b = a.select((F.col("load_id") + 1).alias("load_id"), "column_name", *[F.col(c).alias(f"p_{c}") for c in a.columns[2:]])

    def moved(part: str, whole: Column, p_whole: Column, least: float) -> Column:
        d = F.abs(F.try_divide(F.col(part), whole) - F.try_divide(F.col(f"p_{part}"), p_whole))
        return F.coalesce(d >= F.lit(least - 1e-9), F.lit(False))

    filled, p_filled = F.col("n_rows") - F.col("n_blank"), F.col("p_n_rows") - F.col("p_n_blank")
    findings = F.array_compact(
        F.array(
            F.when(moved("n_blank", F.col("n_rows"), F.col("p_n_rows"), NULL_CHANGE), F.lit("null_change")),
            F.when(moved("n_top", filled, p_filled, TOP_CHANGE), F.lit("top_change")),
            F.when(moved("n_alt", F.col("n_well"), F.col("p_n_well"), FORM_CHANGE), F.lit("form_change")),
        )
    )
    simple = a.join(b, KEYS).select(*KEYS, F.explode(findings).alias("finding"))
    regional = region_shares(counts, rules).where(F.col("region_distance") >= REGION_CHANGE - 1e-9)
    return simple.unionByName(regional.select(*KEYS, F.lit("region_change").alias("finding")))


def violations(counts: DataFrame, rows: DataFrame, row_id: str, rules: dict[str, Rule] | None = None, load: str = "load_id") -> DataFrame:
    """(load_id, column_name, row id) of each row of ``rows`` with a value that ``counts`` has and that isn't well-formed."""
    rules = RULES if rules is None else rules
    bad = judged(counts.where(F.col("column_name").isin(*rules) & F.col("value").isNotNull()), rules).where("NOT well").select(*KEYS, "value")
    cells = unpivot(rows.select(F.col(load).alias("load_id"), row_id, *rules), list(rules), ["load_id", row_id])
    cells = cells.withColumn("value", fields.trimmed(F.col("value"))).where(F.col("value").isNotNull())
    return cells.join(bad, [*KEYS, "value"], "left_semi").select("load_id", row_id, "column_name")
