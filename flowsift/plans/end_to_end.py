"""The reference's all-in-one run as one driver function: profile, clean,
write the cleaned table (A4), prepare and write the train/test dataset (A5),
fit the four model families, save them (A7), score the held-out rows and
write the comparison and the recommendation (A8, N8, N9).

Every step is a Spark job; the driver only decides (column drops, category
lists) and keeps small results. Outputs go under ``out`` (a shared folder).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowsift.operators import evaluate as N
from flowsift.operators import profile as P
from flowsift.plans.modelling import fit_and_score, prepare_flows
from flowsift.plans.preprocess import clean_flows, raw_log_from_view
from flowsift.sources import logs
from flowsift.sources.views import flows


def run(spark: SparkSession, sf_dir: str, out: str, kinds: Sequence[str] = ("rf", "gbt", "svm", "mlp"),
        params: dict | None = None) -> dict:
    params = params or {}
    raw = raw_log_from_view(flows(spark, sf_dir))
    logs.write_metrics(P.missing_report(raw), f"{out}/reports/missing")
    logs.write_flows(clean_flows(raw), f"{out}/cleaned")
    data, feats = prepare_flows(spark, sf_dir)
    logs.write_dataset(data.filter(F.col("split") == "train").drop("split"),
                       data.filter(F.col("split") == "test").drop("split"), f"{out}/dataset", feats, "target")
    scored = {}
    for k in kinds:
        model, s = fit_and_score(k, data, feats, **params.get(k, {}))
        logs.save_model(model, f"{out}/models/{k}")
        scored[k] = s
    table = N.comparison_table(scored, "target")
    logs.write_metrics(table, f"{out}/metrics/comparison")
    rec = N.recommendation(table)
    logs.write_metrics(rec, f"{out}/metrics/recommendation")
    return {"features": feats, "comparison": [r.asDict() for r in table.collect()],
            "recommendation": [r.asDict() for r in rec.collect()]}
