"""What a dataset looks like and how a run is configured."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

# Names and numbers of the strategies, names, defaults and ranges of the settings below.
STRATEGIES = {
    1: "pooled",
    2: "fedavg_region",
    3: "gated_hospital",
    4: "fedprox_region",
    5: "label_skew",
}
ALGORITHMS = ("logistic_regression", "mlp")


@dataclass(frozen=True)
class DatasetSpec:
    """Roles of the columns of a cohort table (one row per subject visit)."""

    name: str
    features: tuple[str, ...]
    label: str = "readmitted"
    key: str = "patientunitstayid"
    subject: str | None = None
    region: str = "region"
    hospital: str = "hospitalid"
    # numeric columns that augmentation moves; empty = the features
    jitter: tuple[str, ...] = ()
    strategies: tuple[int, ...] = (1, 2, 3, 4, 5)
    augment: bool = False

    def __post_init__(self):
        if not self.features:
            raise ValueError("a dataset needs at least one feature")
        if len(set(self.features)) != len(self.features):
            raise ValueError("feature names repeat")

    @property
    def size(self) -> int:
        return len(self.features)

    @property
    def jitter_columns(self) -> tuple[str, ...]:
        return self.jitter or self.features


def _as_bool(value) -> bool:
    if isinstance(value, str):
        text = value.strip().lower()
        if text in ("true", "1", "yes"):
            return True
        if text in ("false", "0", "no", ""):
            return False
        raise ValueError(f"not a boolean: {value!r}")
    return bool(value)


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run; out-of-range values are refused."""

    global_test_size: float = 0.20
    algorithm: str = "logistic_regression"
    fl_rounds: int = 3
    cv_folds: int = 5
    n_clusters: int = 3
    min_hospital_stays: int = 10
    min_hospital_pos: int = 2
    min_hospital_neg: int = 2
    augment_data: bool = True
    augment_target_per_hosp: int = 30
    auroc_gate: float = 0.55
    fedprox_mu: float = 0.01
    dirichlet_alpha: float = 0.5
    noniid_n_clients: int = 5
    strategies: tuple[int, ...] = (1, 2, 3, 4)
    random_state: int = 0
    n_bootstrap: int = 200
    bootstrap_seed: int = 7
    c: float = 0.01
    prox_mode: str = "interpolate"
    holdout: str = "train"

    def __post_init__(self):
        problems = self.problems()
        if problems:
            raise ValueError("; ".join(problems))

    def problems(self) -> list[str]:
        checks = [
            (self.algorithm in ALGORITHMS, f"unknown algorithm {self.algorithm!r}"),
            (1 <= self.fl_rounds <= 20, "fl_rounds must be 1 to 20"),
            (2 <= self.cv_folds <= 10, "cv_folds must be 2 to 10"),
            (2 <= self.n_clusters <= 10, "n_clusters must be 2 to 10"),
            (0.0 < self.global_test_size < 1.0, "global_test_size must be between 0 and 1"),
            (self.fedprox_mu >= 0.0, "fedprox_mu must not be negative"),
            (self.dirichlet_alpha >= 0.01, "dirichlet_alpha must be at least 0.01"),
            (self.noniid_n_clients >= 1, "noniid_n_clients must be at least 1"),
            (self.prox_mode in ("interpolate", "proximal"), "prox_mode is interpolate or proximal"),
            (self.holdout in ("train", "global"), "holdout is train or global"),
            (all(s in STRATEGIES for s in self.strategies), "unknown strategy number"),
        ]
        return [text for ok, text in checks if not ok]

    @classmethod
    def from_dict(cls, given: dict) -> RunConfig:
        """Build from loose values, e.g. JSON; unknown names are ignored."""
        kinds = {"int": int, "float": float, "bool": _as_bool, "str": str}
        values = {}
        for f in fields(cls):
            if f.name not in given:
                continue
            raw = given[f.name]
            values[f.name] = (
                tuple(int(s) for s in raw) if f.name == "strategies" else kinds[f.type](raw)
            )
        return cls(**values)

    def to_dict(self) -> dict:
        return asdict(self)
