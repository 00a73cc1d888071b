"""Directed movements of a subject: an anchored interval join with continuity rules and a reason for every rejected anchor.

Anchors are exits flagged as transfers. A candidate is another record of the same subject that begins ``min_hours`` to
``max_hours`` after the exit, both included, with the same sex, age and diagnosis chapter; the nearest wins.

The join runs on (subject, scope, day): an anchor's window touches few days, so a subject with very many records is spread
over its days. Candidates equal in all that is compared are one candidate with its two smallest ids, so copies of a record
never multiply (two, for an anchor may not match itself; of two facilities, where it may not match its own).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..session import cut


@dataclass(frozen=True)
class MatchConfig:
    subject: str = "patient_id"
    flag: str = "PA_TRANSF"
    reason: str = "PA_MOTSAI"
    sex: str = "PA_SEXO"
    age: str = "PA_IDADE"
    diagnosis: str = "PA_CIDPRI"
    facility: str = "PA_CODUNI"
    entry: str = "DT_INTER"
    exit: str = "DT_SAIDA"
    scope: str | None = None
    order: str | None = None
    min_hours: int = 24
    max_hours: int = 48
    exclude_same_facility: bool = False
    method: str = "4pillars_strict"
    confidence: float = 1.0
    rule_version: str = "v1_pillars"
    revision: str = "2021-01-01"

    def __post_init__(self) -> None:
        if self.min_hours < 0 or self.max_hours < self.min_hours:
            raise ValueError("the window must not be negative or inverted")


REASONS = (
    "missing_patient_key", "missing_discharge_datetime", "missing_demographic_data", "missing_or_invalid_icd",
    "no_candidate_in_time_window", "demographic_mismatch", "clinical_discontinuity",
)


def is_anchor(flag: Column, reason: Column, codes: list[str]) -> Column:
    """The flag is the number 1 (cut to a whole number) or the reason is one of ``codes``."""
    return (nz.number_or(flag, 0.0).cast("long") == 1) | nz.text(reason).isin(codes or [""]) & F.lit(bool(codes))


def prepare(records: DataFrame, codes: list[str], cfg: MatchConfig) -> DataFrame:
    """Typed and normalised records. A missing flag or reason column never triggers; other missing columns raise."""
    need = {cfg.subject, cfg.sex, cfg.age, cfg.diagnosis, cfg.facility, cfg.entry, cfg.exit}
    if missing := sorted(need - set(records.columns)):
        raise ValueError(f"records lack {', '.join(missing)}")
    col = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    as_moment = lambda c: F.col(c).cast("timestamp_ntz") if dict(records.dtypes)[c].startswith("timestamp") else nz.moment(F.col(c))
    icd = nz.diagnosis(F.col(cfg.diagnosis))
    out = records.select(
        (F.col(cfg.order).cast("long") if cfg.order else F.monotonically_increasing_id()).alias("rid"),
        nz.text(F.col(cfg.subject)).alias("subject"),
        (F.col(cfg.scope).cast("string") if cfg.scope else F.lit("")).alias("scope"),
        as_moment(cfg.entry).alias("entered"),
        as_moment(cfg.exit).alias("left"),
        F.upper(nz.text(F.col(cfg.sex))).alias("sex"),
        nz.age(F.col(cfg.age)).alias("age"),
        icd.alias("icd"),
        nz.chapter(icd).alias("chapter"),
        nz.text(F.col(cfg.facility)).alias("facility"),
        is_anchor(col(cfg.flag), col(cfg.reason), codes).alias("anchor"),
    )
    return out


def judge(prepared: DataFrame, cfg: MatchConfig) -> DataFrame:
    """One row per anchor: its outcome (``matched`` or a reason) and the best candidate.

    Anchors of a subject that has records but none with an entry time drop out without a reason; those without a subject stay.
    """
    base = prepared.where("anchor")
    seen = prepared.where((F.col("subject") != "") & F.col("entered").isNotNull()).select("subject", "scope").distinct()
    nameless = base.where("subject = ''")
    named = base.where("subject != ''").join(seen, ["subject", "scope"], "left_semi")

    day = lambda t: F.datediff(t, F.lit("1970-01-01").cast("date"))
    same = ["subject", "scope", "entered", "sex", "age", "icd", "chapter"]
    cand = prepared.where((F.col("subject") != "") & F.col("entered").isNotNull())
    if cfg.exclude_same_facility:
        # an anchor sees no row of its own facility, so of two facilities one row each
        cand = cand.groupBy(*same, "facility").agg(F.min("rid").alias("rid"))
    # a limit of rows per group, which each map task applies before the shuffle
    twins = Window.partitionBy(*same).orderBy("facility", "rid")
    cand = cand.withColumn("_n", F.row_number().over(twins)).where("_n <= 2")
    cand = cand.select(
        F.col("subject").alias("c_subject"), F.col("scope").alias("c_scope"), day(F.col("entered")).alias("c_day"), F.col("rid").alias("c_rid"),
        F.col("entered").alias("c_entered"), F.col("sex").alias("c_sex"), F.col("age").alias("c_age"), F.col("icd").alias("c_icd"),
        F.col("chapter").alias("c_chapter"), F.col("facility").alias("c_facility"),
    )
    lo = F.col("left") + F.make_dt_interval(F.lit(0), F.lit(cfg.min_hours), F.lit(0), F.lit(0))
    hi = F.col("left") + F.make_dt_interval(F.lit(0), F.lit(cfg.max_hours), F.lit(0), F.lit(0))
    complete = F.col("left").isNotNull() & (F.col("sex") != "") & F.col("age").isNotNull() & F.col("chapter").isNotNull()
    windows = named.where(complete).select("*", lo.alias("lo"), hi.alias("hi")).withColumn("a_day", F.explode(F.sequence(day(F.col("lo")), day(F.col("hi")))))
    on = (
        (F.col("subject") == F.col("c_subject")) & (F.col("scope") == F.col("c_scope")) & (F.col("a_day") == F.col("c_day"))
        & F.col("c_entered").between(F.col("lo"), F.col("hi")) & (F.col("rid") != F.col("c_rid"))
    )
    if cfg.exclude_same_facility:
        on = on & (F.col("facility") != F.col("c_facility"))
    demo = (F.col("sex") == F.col("c_sex")) & F.coalesce(F.col("age") == F.col("c_age"), F.lit(False))
    clin = demo & F.coalesce(F.col("chapter") == F.col("c_chapter"), F.lit(False))
    delta = nz.hours_between(F.col("c_entered"), F.col("left"))
    order = F.struct(delta.alias("delta"), F.coalesce(F.col("icd") != F.col("c_icd"), F.lit(True)).alias("other"), F.col("c_facility").alias("target"), F.col("c_entered").alias("entered"), F.col("c_rid").alias("rid"))
    per = windows.join(cand, on).groupBy("rid").agg(
        F.count(F.lit(1)).alias("n_time"), F.count_if(demo).alias("n_demo"), F.count_if(clin).alias("n_clin"), F.min(F.when(clin, order)).alias("best")
    )
    nil = lambda c: F.coalesce(F.col(c), F.lit(0))
    outcome = nz.first_true(
        [
            (F.col("subject") == "", REASONS[0]), (F.col("left").isNull(), REASONS[1]), ((F.col("sex") == "") | F.col("age").isNull(), REASONS[2]),
            (F.col("chapter").isNull(), REASONS[3]), (nil("n_time") == 0, REASONS[4]), (nil("n_demo") == 0, REASONS[5]), (nil("n_clin") == 0, REASONS[6]),
        ],
        "matched",
    )
    return named.unionByName(nameless).join(per, "rid", "left").withColumn("outcome", outcome)


def events(judged: DataFrame, cfg: MatchConfig) -> DataFrame:
    b = F.col("best")
    scope = [F.col("scope").alias("period")] if cfg.scope else []
    return judged.where("outcome = 'matched'").select(
        *scope,
        nz.stable_hash(F.col("facility"), b["target"], nz.moment_text(F.col("left")), nz.moment_text(b["entered"]), F.col("subject"), F.lit(cfg.rule_version)).alias("event_id"),
        F.col("facility").alias("source_facility_id"),
        b["target"].alias("target_location_id"),
        F.lit("facility").alias("target_location_type"),
        F.col("left").alias("source_discharge_datetime"),
        b["entered"].alias("target_admission_datetime"),
        b["delta"].alias("delta_hours"),
        F.lit(cfg.method).alias("match_method"),
        F.lit(cfg.confidence).alias("confidence_score"),
        F.lit(cfg.rule_version).alias("rule_version"),
        F.lit(cfg.revision).alias("assumption_revision"),
    )


def rejections(judged: DataFrame) -> DataFrame:
    return judged.where("outcome != 'matched'").groupBy(F.col("outcome").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def transfer_edges(ev: DataFrame) -> DataFrame:
    """Events as weighted edges (of each period, where events have one). Null keys are kept; the edge id ignores type and method."""
    keys = ["source_facility_id", "target_location_id", "target_location_type", "match_method", "rule_version", "assumption_revision"]
    period = [c for c in ("period",) if c in ev.columns]
    grouped = ev.groupBy(*keys, *period).agg(F.count("event_id").alias("transfer_count"), F.avg("confidence_score").alias("confidence_score"))
    edge_id = nz.stable_hash(*[F.col(k) for k in (keys[0], keys[1], keys[4], keys[5])])
    return grouped.select(
        edge_id.alias("edge_id"), *keys[:3], "transfer_count", F.lit(None).cast("double").alias("distance_km"), keys[3], "confidence_score", *keys[4:], *period
    )


def infer(records: DataFrame, codes: list[str], cfg: MatchConfig | None = None) -> tuple[DataFrame, DataFrame]:
    cfg = cfg or MatchConfig()
    judged = cut(judge(numbered(prepare(records, codes, cfg), cfg), cfg))
    return events(judged, cfg), rejections(judged)


def numbered(prepared: DataFrame, cfg: MatchConfig) -> DataFrame:
    """``judge`` reads records twice and tells them by ``rid``; without an ``order`` the numbers are only fixed once they are written."""
    return prepared if cfg.order else cut(prepared)


def key_collisions(keys: DataFrame, key: str) -> DataFrame:
    """How far a linkage key falls short of being unique; blank keys are left out. ``rows_in_collision``: rows beyond the first."""
    per = keys.where(nz.text(F.col(key)) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows, unique = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return per.agg(
        rows.alias("rows_total"), unique.alias("unique_keys"), F.count_if(F.col("n") > 1).alias("colliding_groups"),
        (rows - unique).alias("rows_in_collision"), nz.ratio(rows - unique, rows).alias("collision_ratio"),
    )
