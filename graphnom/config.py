"""Settings of a run: immutable, read from JSON, never executed."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace
from enum import Enum

from pyspark.sql import SparkSession


class Dtype(Enum):
    CATEGORICAL = "categorical"
    NUMERIC = "numeric"


SIMILARITIES = ("PMIs", "NPMI1s", "NPMI2s", "conditional_prob")
EMBEDDINGS = ("adj", "adj+diag", "normlap", "regnormlap")
CLASSIFIERS = ("logreg", "naive_bayes", "randfor", "boost", "kde")


@dataclass(frozen=True)
class Config:
    """Defaults are the fixed values that a run without settings uses."""

    edges_filename: str = "undirected_edges.dat"
    attr_filename: str = "node_attributes.csv"
    use_context: bool = True
    predictor_types: tuple[tuple[str, Dtype], ...] = (("employer", Dtype.CATEGORICAL), ("major", Dtype.CATEGORICAL), ("school", Dtype.CATEGORICAL))
    nomination_type: str = "places_lived"
    nomination_value: str = "new york"
    load_embeddings: bool = True
    verbose: bool = True
    save_info: bool = True
    rank_thresh: int = 100
    nominate_max: int = 500
    rng_seed: int = 123
    n_jobs: int = 4
    sim: str = "NPMI1s"
    delta: float = 0.0
    embedding: str = "adj"
    max_eig: int = 200
    which_elbow: int = 2
    use_pca: bool = False
    max_eig_pca: int | None = None
    which_elbow_pca: int = 2
    whiten: bool = True
    sphere_context: bool = True
    sphere_content: bool = False
    imputation: str = "mean"
    classifier: str = "logreg"
    num_trees: int = 100
    cv_max: int = 100
    kde_grid: int = 31
    kde_range: float = 100.0
    kde_folds: int = 10

    def __post_init__(self) -> None:
        checks = ((self.sim, SIMILARITIES), (self.embedding, EMBEDDINGS), (self.classifier, CLASSIFIERS), (self.imputation, ("mean", "median")))
        for value, known in checks:
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")
        if (self.delta > 0) != (self.sim == "PMIs"):
            raise ValueError("smoothing (delta) goes with PMIs, and only with it")

    @property
    def categorical(self) -> tuple[str, ...]:
        """Predictors of the classifier: the nomination type is never one."""
        return tuple(t for t, d in self.predictor_types if d is Dtype.CATEGORICAL and t != self.nomination_type)

    @property
    def numeric(self) -> tuple[str, ...]:
        return tuple(t for t, d in self.predictor_types if d is Dtype.NUMERIC and t != self.nomination_type)

    @property
    def embedded(self) -> tuple[str, ...]:
        """Types that get a content embedding: all categorical ones, the nomination type too if it is listed."""
        return tuple(t for t, d in self.predictor_types if d is Dtype.CATEGORICAL)

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


def from_json(text: str) -> Config:
    """Settings from a JSON object; predictor_types is an object of name to dtype."""
    given = json.loads(text)
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    if "predictor_types" in given:
        given["predictor_types"] = tuple((k, Dtype(v)) for k, v in given["predictor_types"].items())
    return Config(**given)


def load(spark: SparkSession, path: str) -> Config:
    """from_json of a file that Spark can reach."""
    return from_json(spark.read.text(path, wholetext=True).first()[0])


def parse_items(items: Iterable[tuple[str, str]]) -> dict[str, object]:
    """Settings written as text: what follows `#` is dropped; literals become values, all else stays text."""
    out: dict[str, object] = {}
    for key, text in items:
        text = text.partition("#")[0].strip()
        try:
            out[key] = ast.literal_eval(text)
        except (ValueError, SyntaxError):
            out[key] = text
    return out
