from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def log_run(spark: SparkSession, root: str, model_name: str, params: dict, metrics: dict) -> str:
    """Append one experiment run and return its id."""
    if not model_name:
        raise ValueError("a run needs a model name")
    run_id = uuid.uuid4().hex
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"),
        F.lit(model_name).alias("model_name"),
        F.parse_json(F.lit(json.dumps(params))).alias("params"),
        F.parse_json(F.lit(json.dumps(metrics))).alias("metrics"),
        F.current_timestamp().alias("created_at"),
    )
    row.write.mode("append").parquet(f"{root}/runs")
    return run_id
