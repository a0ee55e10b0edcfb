"""What the degradation operators need to know about a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# Tokens written by the validity operator.
INVALID_TEXT = ["??", "N/A", "--", "abc", "1O.O"]
INVALID_FLAG = ["2", "-1", "3"]
INVALID_CATEGORY = ["X", "U", "?"]


@dataclass(frozen=True)
class TableSpec:
    """Roles of the columns of one table.

    Columns that are neither ``numeric`` nor ``categorical`` (ids, target, outcomes)
    are protected: no operator touches them. ``ids`` together identify a row.
    """

    ids: Sequence[str]
    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    flags: Sequence[str] = ()
    severity: str | None = None
    swaps: Sequence[tuple[str, str]] = ()
    noise_cv: Mapping[str, float] = field(default_factory=dict)
    default_cv: float = 0.05
    additive_bias: Mapping[str, float] = field(default_factory=dict)
    multiplicative_bias: Mapping[str, float] = field(default_factory=dict)
    donor_column: str | None = None
    donor_quantile: float = 0.80
    invalid_category: Sequence[str] = tuple(INVALID_CATEGORY)

    @property
    def predictors(self) -> list[str]:
        return [*self.numeric, *self.categorical]


# The intensive-care cohort layout, noise and bias tables, sentinels.
ICU_IDS = ["subject_id", "hadm_id", "stay_id"]
ICU_TARGET = "in_hospital_mortality"
ICU_NUMERIC = [
    "age", "hr_mean", "sbp_mean", "dbp_min", "rr_mean", "spo2_min", "wbc_min",
    "aniongap_min", "aniongap_max", "bun_min", "inr_min", "inr_max", "ptt_min",
    "urine_output", "dobutamine", "dopamine", "norepinephrine", "phenylephrine",
]
ICU_FLAGS = ["dobutamine", "dopamine", "norepinephrine", "phenylephrine"]
ICU_SWAPS = [
    ("aniongap_min", "aniongap_max"),
    ("inr_min", "inr_max"),
    ("sbp_mean", "dbp_min"),
    ("hr_mean", "rr_mean"),
]
ICU_NOISE_CV = {
    "hr_mean": 0.05, "sbp_mean": 0.05, "dbp_min": 0.05, "rr_mean": 0.05, "spo2_min": 0.05,
    "wbc_min": 0.03, "aniongap_min": 0.03, "aniongap_max": 0.03, "bun_min": 0.03,
    "inr_min": 0.03, "inr_max": 0.03, "ptt_min": 0.03,
    "dobutamine": 0.10, "dopamine": 0.10, "norepinephrine": 0.10, "phenylephrine": 0.10,
}
ICU_ADDITIVE = {"sbp_mean": 3.0, "dbp_min": 2.0, "rr_mean": 1.0, "spo2_min": -1.0}
ICU_MULTIPLICATIVE = {
    "hr_mean": 0.03, "wbc_min": 0.05, "bun_min": 0.05, "inr_max": 0.05,
    "ptt_min": 0.05, "urine_output": 0.10,
}
ICU_SENTINELS = {
    "age": -99.0, "hr_mean": -9.0, "sbp_mean": -1.0, "dbp_min": -1.0, "rr_mean": -1.0,
    "spo2_min": -5.0, "wbc_min": -1.0, "aniongap_min": -1.0, "aniongap_max": -1.0,
    "bun_min": -1.0, "inr_min": -1.0, "inr_max": -1.0, "ptt_min": -1.0,
    "urine_output": -9999.0, "dobutamine": -1.0, "dopamine": -1.0,
    "norepinephrine": -1.0, "phenylephrine": -1.0,
}

ICU_COHORT = TableSpec(
    ids=ICU_IDS,
    numeric=ICU_NUMERIC,
    categorical=["gender"],
    flags=ICU_FLAGS,
    severity="norepinephrine",
    swaps=ICU_SWAPS,
    noise_cv=ICU_NOISE_CV,
    additive_bias=ICU_ADDITIVE,
    multiplicative_bias=ICU_MULTIPLICATIVE,
    donor_column="age",
)
