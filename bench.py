"""Headline timings: prints one JSON line.

Each query runs once to warm up and is then timed over a ``noop`` write, so that
the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ.setdefault("OPENBLAS_NUM_THREADS", "4")  # beside Spark's own threads more of them wait for one another
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from seriesforge.functions.kernels import make_kernels  # noqa: E402
from seriesforge.operators.normalise import znormalise  # noqa: E402
from seriesforge.operators.ridge import fit_ridge  # noqa: E402
from seriesforge.operators.softmax import SoftmaxTrainer  # noqa: E402
from seriesforge.operators.transform import transform_sql, transform_wide  # noqa: E402
from seriesforge.plans.queries import queries, user_series, vectors  # noqa: E402
from seriesforge.sources.series import split_holdout  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    series = znormalise(vectors(spark, SF)).repartition(4 * int(CPUS)).persist()
    n = series.count()
    banks = {k: make_kernels(64, k, 1) for k in (100, 1000, 10_000)}
    registered = queries()
    valid, train = split_holdout(vectors(spark, SF), 512)
    jobs = {
        **{f"transform_k{k}": (lambda b=b: noop(transform_wide(series, b))) for k, b in banks.items()},
        "transform_sql_k100": lambda: noop(transform_sql(series, banks[100].to_df(spark))),
        "ridge_fit_k1000": lambda: fit_ridge(series, banks[1000]),
        **{f"softmax_train_k{k}": (lambda b=b: SoftmaxTrainer(10).fit(train, valid, b)) for k, b in banks.items()},
        "events_to_series": lambda: noop(user_series(spark, SF)),
        **{q: (lambda q=q: noop(registered[q](spark, SF))) for q in ("transform_long", "transform_events", "feature_standardised", "linear_scores", "series_znorm", "minibatch_assign")},
    }
    took = {}
    for name, job in jobs.items():
        if not name.endswith("k10000"):
            job()
        at = time.perf_counter()
        job()
        took[name] = round(time.perf_counter() - at, 3)
    rates = {f"series_per_s_k{k}": round(n / took[f"transform_k{k}"], 1) for k in banks}
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, **rates}))


if __name__ == "__main__":
    main()
