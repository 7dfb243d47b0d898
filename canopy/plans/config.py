"""Run configuration: a frozen dataclass for each algorithm, read from JSON and validated up front."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

VOTING = ("majority", "soft", "weighted")
ESTIMATORS = ("histogram", "gaussian")


@dataclass(frozen=True)
class HoeffdingConfig:
    type: str = "srp"  # srp: one feature subspace a tree; arf: one a leaf
    drift_detection: bool = True
    max_bins: int = 32
    n_min: int = 50
    delta: float = 0.01
    tau: float = 0.05
    features_patch: float | None = 0.6
    lambda_: float = 6.0
    adwin_delta_warning: float = 1e-4
    adwin_delta_drift: float = 1e-5
    numeric_estimator: str = "histogram"

    def __post_init__(self) -> None:
        if self.type not in ("srp", "arf"):
            raise ValueError(f"unknown Hoeffding type {self.type!r}")
        if self.numeric_estimator not in ESTIMATORS:
            raise ValueError(f"unknown numeric estimator {self.numeric_estimator!r}")
        if not self.lambda_ > 0 or self.n_min < 1 or self.max_bins < 2 or not 0 < self.delta < 1:
            raise ValueError("lambda must be over 0, n_min at least 1, max_bins at least 2 and delta between 0 and 1")
        if self.features_patch is not None and not 0 < self.features_patch <= 1:
            raise ValueError("features_patch must be over 0 and at most 1")

    def subspace_size(self, n_features: int) -> int:
        """Computed once as a whole number: ceil(p * n), or floor(sqrt(n)) + 1 without p."""
        size = math.ceil(self.features_patch * n_features - 1e-9) if self.features_patch is not None else math.isqrt(n_features) + 1
        return max(1, min(n_features, size))


@dataclass(frozen=True)
class MondrianConfig:
    type: str = "amf"
    step: float = 1.0
    #: None: 0.5 for two classes, else 0.01.
    dirichlet: float | None = None
    split_pure: bool = False

    def smoothing(self, n_classes: int) -> float:
        return self.dirichlet if self.dirichlet is not None else 0.5 if n_classes == 2 else 0.01


@dataclass(frozen=True)
class EnsembleConfig:
    dataset: str
    n_trees: int
    seed: int
    algorithm: HoeffdingConfig | MondrianConfig = field(default_factory=HoeffdingConfig)
    voting: str = "soft"
    #: "before": a tree's accuracy over earlier instances weighs its vote; "after" counts the instance itself too.
    accuracy_timing: str = "before"

    def __post_init__(self) -> None:
        if self.voting not in VOTING or self.accuracy_timing not in ("before", "after") or self.n_trees < 1:
            raise ValueError("unknown voting or accuracy_timing, or no trees")

    @classmethod
    def from_json(cls, text: str) -> EnsembleConfig:
        raw = json.loads(text)
        missing = {"dataset", "n_trees", "seed", "algorithm"} - set(raw)
        if missing:
            raise ValueError(f"missing keys: {', '.join(sorted(missing))}")
        algorithm = {("lambda_" if k == "lambda" else k): v for k, v in raw["algorithm"].items()}
        if "numeric_estimator" in algorithm:
            algorithm["numeric_estimator"] = algorithm["numeric_estimator"].lower()
        kind = MondrianConfig if algorithm["type"] == "amf" else HoeffdingConfig
        return cls(raw["dataset"], raw["n_trees"], raw["seed"], kind(**algorithm), raw.get("voting", "soft").lower(), raw.get("accuracy_timing", "before"))

    def to_json(self) -> str:
        out = asdict(self)
        if "lambda_" in out["algorithm"]:
            out["algorithm"]["lambda"] = out["algorithm"].pop("lambda_")
        return json.dumps(out, indent=2)
