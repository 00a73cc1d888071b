"""Binding logical roles to the first available physical column. Analysis time only: no Spark job."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz

# Canonical columns with their aliases in order of priority, and optional linkage columns.
CANONICAL = {
    "CODMUNRES": ("CODMUNRES", "MUNIC_RES", "PA_MUNPCN"),
    "CNES": ("CNES", "PA_CODUNI", "CGC_HOSP"),
    "DIAG_PRINC": ("DIAG_PRINC", "PA_CIDPRI"),
    "NASC": ("NASC", "DT_NASC", "DT_NASCIMENTO", "PA_NASC"),
    "IDADE": ("IDADE", "PA_IDADE"),
    "SEXO": ("SEXO", "PA_SEXO"),
    "DT_INTER": ("DT_INTER",),
    "DT_SAIDA": ("DT_SAIDA",),
    "MOT_SAIDA": ("MOT_SAIDA", "COBRANCA", "PA_MOTSAI"),
    "PA_TRANSF": ("PA_TRANSF",),
    "DIAS_PERM": ("DIAS_PERM", "PA_PERMAN"),
    "MARCA_UTI": ("MARCA_UTI", "UTI_MES_TO", "UTI_INT_TO"),
    "PROC_REA": ("PROC_REA", "PA_PROC_ID"),
    "VAL_TOT": ("VAL_TOT", "PA_VALAPR", "PA_VALPRO"),
    "RACA_COR": ("RACA_COR", "PA_RACACOR"),
}
LINKAGE = ("N_AIH", "NUM_PROC", "PA_CNSMED", "PA_CNPJCPF")

# Candidates per role, in order of priority. The lists of gate and nodes differ on purpose.
ROLES = {
    "patient_key": ("PA_CNSMED", "PA_CNPJCPF", "PA_AUTORIZ", "N_AIH", "NUM_PROC"),
    "birthdate": ("NASC", "DT_NASC", "DT_NASCIMENTO", "PA_NASC"),
    "residence": ("MUNIC_RES", "CODMUNRES", "PA_MUNPCN"),
    "destination": ("PA_MUNPCN", "DEST_CODUNI", "CNES_DEST", "MUNIC_RES", "CODMUNRES", "CNES", "PA_CODUNI"),
    "origin_facility": ("PA_CODUNI", "CNES", "CGC_HOSP"),
    "transfer_flag": ("PA_TRANSF",),
    "transfer_reason": ("PA_MOTSAI", "MOT_SAIDA", "COBRANCA"),
    "sex": ("PA_SEXO", "SEXO"),
    "age": ("PA_IDADE", "IDADE"),
    "diagnosis": ("PA_CIDPRI", "DIAG_PRINC"),
    "node_facility": ("CNES", "PA_CODUNI", "CGC_HOSP"),
    "facility_municipality": ("MUNIC_MOV", "CODMUNRES", "MUNIC_RES", "PA_MUNPCN", "PA_UFMUN"),
    "node_municipality": ("MUNIC_RES", "CODMUNRES", "MUNIC_MOV", "PA_MUNPCN", "PA_UFMUN"),
    "state_filter": ("MUNIC_RES", "MUNIC_MOV", "CODMUNRES", "PA_MUNPCN"),
}
DATETIME_PAIRS = (
    ("DT_INTER", "DT_SAIDA"), ("DT_INTER", "DT_ALTA"), ("DT_ADMISSAO", "DT_ALTA"), ("DATA_ENTRADA", "DATA_SAIDA"), ("PA_DT_INTER", "PA_DT_ALTA"),
)
OUTPATIENT_MARKS, INPATIENT_MARKS = {"PA_CODUNI", "PA_PROC_ID", "PA_CMP"}, {"MUNIC_RES", "DIAG_PRINC", "DT_INTER", "DT_SAIDA"}

# Exit codes by outcome.
OUTCOMES = {
    "transfer": ("31", "32"),
    "discharge": ("11", "12", "14", "15", "16", "18"),
    "permanence": ("21",),
    "death": ("41", "42", "43"),
}


def first_available(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    have = set(columns)
    return next((c for c in candidates if c in have), None)


def first_pair(columns: Iterable[str], pairs: Sequence[tuple[str, str]] = DATETIME_PAIRS) -> tuple[str, str] | None:
    have = set(columns)
    return next((p for p in pairs if have.issuperset(p)), None)


def projection(columns: Iterable[str], with_linkage: bool = False) -> tuple[dict[str, str], list[str]]:
    """Canonical name to physical column, and the canonical names nothing stands for."""
    columns = list(columns)
    found = {name: c for name, aliases in CANONICAL.items() if (c := first_available(columns, aliases))}
    if with_linkage:
        found |= {c: c for c in LINKAGE if c in columns}
    return found, [name for name in CANONICAL if name not in found]


def project(df: DataFrame, with_linkage: bool = False) -> DataFrame:
    """The canonical columns as strings, missing ones null; everything else is pruned at the scan."""
    found, _ = projection(df.columns, with_linkage)
    names = [*CANONICAL, *(c for c in found if c not in CANONICAL)]
    return df.select(*[(F.col(found[n]) if n in found else F.lit(None)).cast("string").alias(n) for n in names])


def outcome_features(df: DataFrame, code: str = "MOT_SAIDA") -> DataFrame:
    """Four flags and a group by exit code; null or unknown codes are ``other`` with all flags false."""
    c = nz.zero_fill(nz.text(F.col(code)), 2)
    is_ = {k: F.coalesce(c.isin(*v), F.lit(False)) for k, v in OUTCOMES.items()}
    group = nz.first_true([(v, k) for k, v in is_.items()], "other")
    return df.withColumns({
        "IS_TRANSFER_REGULATED": is_["transfer"], "IS_DISCHARGE": is_["discharge"], "IS_PERMANENCE": is_["permanence"],
        "IS_DEATH": is_["death"], "MOT_SAIDA_GROUP": group,
    })


# --- schema gate ---------------------------------------------------------------------------------------------------------
# What a source must have.
REQUIRED = {
    "siasus": {"PA_SEXO", "PA_IDADE", "PA_CIDPRI", "PA_CODUNI"},
    "sih": {"SEXO", "IDADE", "DIAG_PRINC"},
}


def source_profile(columns: Iterable[str]) -> str:
    """``siasus``, ``sih`` or ``unknown``; an unknown source is held to the requirements of the first."""
    have = set(columns)
    return "siasus" if have >= OUTPATIENT_MARKS else "sih" if have >= INPATIENT_MARKS else "unknown"


@dataclass
class GateResult:
    total_columns: int
    profile: str
    missing_required: list[str]
    roles: dict[str, str | None]
    datetime_pair: tuple[str, str] | None
    probabilistic: bool
    blockers: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.blockers

    def as_dict(self) -> dict:
        return asdict(self) | {"passed": self.passed}

    def __str__(self) -> str:
        head = [f"Schema gate: {'PASS' if self.passed else 'FAIL'}", f"profile {self.profile}, {self.total_columns} columns", f"datetimes {self.datetime_pair}"]
        return "\n".join([*head, *(f"{k}: {v}" for k, v in self.roles.items()), *(f"blocker: {b}" for b in self.blockers), *(f"note: {w}" for w in self.warnings)])


def gate_headers(headers: DataFrame, key: str, header: str) -> DataFrame:
    """The gate's verdict for every row of ``headers``, whose column ``header`` is an array of field names."""

    def run(batches):
        for b in batches:
            out = []
            for k, names in zip(b[key], b[header]):
                r = schema_gate(list(names))
                out.append((k, r.total_columns, r.profile, r.passed, r.probabilistic, "/".join(r.datetime_pair or ()), ", ".join(r.missing_required), len(r.blockers), len(r.warnings)))
            yield pd.DataFrame(out, columns=[key, "total_columns", "profile", "passed", "probabilistic", "datetime_pair", "missing_required", "n_blockers", "n_warnings"])

    kind = headers.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, total_columns int, profile string, passed boolean, probabilistic boolean, datetime_pair string, missing_required string, n_blockers int, n_warnings int"
    return headers.select(key, header).mapInPandas(run, schema)


def schema_gate(header: Sequence[str], validated_codes: int | None = None) -> GateResult:
    """Whether a source can feed the matcher. ``validated_codes``: transfer codes validated in the code book, None to skip it."""
    profile = source_profile(header)
    roles = {r: first_available(header, ROLES[r]) for r in (
        "patient_key", "destination", "origin_facility", "transfer_flag", "transfer_reason", "sex", "age", "diagnosis", "birthdate", "residence")}
    probabilistic = all(roles[r] for r in ("birthdate", "residence", "sex", "age"))
    out = GateResult(len(header), profile, sorted(REQUIRED["sih" if profile == "sih" else "siasus"] - set(header)), roles, first_pair(header), probabilistic)
    need = [
        (not out.missing_required, f"required fields are missing: {', '.join(out.missing_required)}"),
        (roles["patient_key"] or probabilistic, "nothing links the records of a subject"),
        (roles["destination"], "no destination field"),
        (roles["origin_facility"], "no origin facility field"),
        (roles["transfer_flag"] or roles["transfer_reason"], "no transfer trigger field"),
        (roles["sex"] and roles["age"] and roles["diagnosis"], "sex, age or diagnosis can't be mapped"),
        (out.datetime_pair, "no day-level pair of entry and exit"),
        (validated_codes is None or not roles["transfer_reason"] or validated_codes > 0, "the code book has no validated transfer code"),
    ]
    out.blockers += [message for ok, message in need if not ok]
    if probabilistic and not roles["patient_key"]:
        out.warnings.append("linkage is probabilistic only")
    if probabilistic and roles["patient_key"] in ("N_AIH", "NUM_PROC"):
        out.warnings.append("the key is that of an episode; probabilistic linkage can avoid it")
    if not out.datetime_pair and {"PA_CMP", "PA_MVM"} <= set(header):
        out.warnings.append("month-level fields only")
    if validated_codes is None or not roles["transfer_reason"]:
        out.warnings.append("the code book was not checked")
    return out
