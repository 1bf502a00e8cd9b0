"""Quality rules: bounds on metrics, by name and technique."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str
    min: float | None = None
    max: float | None = None
    baseline: int = 0
    technique: str | None = None


#: Rules that hold where no file gives others.
DEFAULT_RULES = [
    Rule("saturation", "saturated_fraction", max=0.01),
    Rule("focus_drift", "sharpness_ratio", min=0.5, baseline=3),
    Rule("dropped_frames", "interval_ratio", max=1.8, baseline=3),
    Rule("tic_drop", "tic_ratio", min=0.2, baseline=5),
]


def load_rules(path: str) -> list[Rule]:
    """A TOML file of [[rule]] tables, or JSON."""
    import tomllib

    with open(path, "rb") as f:
        raw = f.read()
    data = json.loads(raw) if path.endswith(".json") else tomllib.loads(raw.decode())
    return [Rule(**{k: v for k, v in r.items() if k in Rule.__dataclass_fields__}) for r in data.get("rule", data if isinstance(data, list) else [])]


def judge(metrics: DataFrame, rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    """Rows of metrics (…, metric, value, n: how many before it in its data set) that break a rule; baseline values aren't judged."""
    rows = [(r.name, r.metric, r.min, r.max, r.baseline) for r in rules]
    table = metrics.sparkSession.createDataFrame(rows, "rule string, metric string, rule_min double, rule_max double, baseline int")
    j = metrics.join(F.broadcast(table), "metric")  # as many rows as rules
    return j.where((F.col("n") >= F.col("baseline")) & F.coalesce((F.col("value") < F.col("rule_min")) | (F.col("value") > F.col("rule_max")), F.col("value") < F.col("rule_min"), F.col("value") > F.col("rule_max"), F.lit(False)))
