"""Queries over the driver tables and their SQL twins.

Doubles of the bank are written as ``'repr'::DOUBLE`` and sums are folds in one
order, so per-row values agree exactly; aggregates over many rows are rounded.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.kernels import KERNEL_LENGTHS, draw_kernels, make_kernels
from seriesforge.operators import evaluate as E
from seriesforge.operators.normalise import fit_feature_scaler, series_stats, standardise, znormalise
from seriesforge.operators.ridge import fit_ridge
from seriesforge.operators.softmax import SoftmaxTrainer
from seriesforge.operators.transform import assemble_wide, output_length, positions, responses, tap, transform_long, transform_sql
from seriesforge.sources.results import RUNS_SCHEMA, SCALING_SCHEMA, results_frame, summarise_runs, union_by_k
from seriesforge.sources.series import read_series_csv, read_series_text, series_from_arrays, series_from_events, split_holdout

LENGTH, EVENT_LENGTH, SEED = 64, 48, 20
BANK = make_kernels(LENGTH, 20, SEED)
SMALL = BANK.prefix(3)
EVENT_BANK = make_kernels(EVENT_LENGTH, 8, SEED + 1)
HOLDOUT, TRANCHE, BATCH = 256, 128, 32
RATES = [(0, 0.1, 2.25), (1, 0.01, 1.5), (2, 0.001, 1.5), (3, 0.0001, 2.0)]
LOSSES = [(1, 2.0), (2, 1.5), (3, 1.5), (4, 1.25), (5, 1.25), (6, 1.5), (7, 1.0), (8, 1.0), (9, 0.75)]
RUNS = [("a", r, 0.75 + r / 64, 1.5 + r, 2.5 - r / 8, 0.25 * r, 0.125) for r in range(4)] + [("b", r, 0.5, 1.0, 2.0, 3.0, 4.0 + r) for r in range(3)]
SCALING = {100: [(256, 0.5, 0.25), (512, 0.625, 0.5)], 1000: [(256, 0.75, 1.0)]}
CLASSES = 3
_W = np.round(np.random.default_rng(5).normal(size=(CLASSES, len(BANK), 2)) / 4, 4)
COEF = [(c, k, float(_W[c, k, 0]), float(_W[c, k, 1]), 0.125 * c) for c in range(CLASSES) for k in range(len(BANK))]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return series_from_arrays(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", "label")


def user_series(spark: SparkSession, sf: str) -> DataFrame:
    return series_from_events(spark.read.parquet(f"{sf}/events.parquet"), EVENT_LENGTH)


def unpack(df: DataFrame, array: str = "x", name: str = "v", *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(array).alias("i", name))


def coefficients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COEF, "class int, kernel_id int, w_ppv double, w_mx double, intercept double")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return E.linear_scores(transform_long(znormalise(vectors(spark, sf)), BANK), coefficients(spark))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("series_id", (F.col("label") % CLASSES).alias("label"))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return E.argmax_class(_scores(spark, sf)).join(_labels(spark, sf), "series_id")


def q_output_length(spark: SparkSession, sf: str) -> DataFrame:
    pairs = vectors(spark, sf).crossJoin(F.broadcast(BANK.to_df(spark)))
    return pairs.select("series_id", "kernel_id", output_length(F.size("x")).cast("bigint").alias("n"))


def q_conv_taps(spark: SparkSession, sf: str) -> DataFrame:
    p = positions(vectors(spark, sf), SMALL.to_df(spark))
    taps = F.array(*[F.struct(F.lit(j).alias("j"), tap(j).alias("product")) for j in range(max(KERNEL_LENGTHS))])
    return p.select("series_id", "kernel_id", "pos", "length", F.inline(taps)).where(F.col("j") < F.col("length")).drop("length")


def q_ridge_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Fits on the training split and scores the held-out one; series as they are."""
    test, train = split_holdout(vectors(spark, sf), HOLDOUT)
    model = fit_ridge(train, BANK)
    return E.accuracy(E.predict(test, BANK, model)).withColumn("alpha", F.lit(float(model.alpha)))


def q_softmax_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Scores rows that neither train nor steer the stop rule."""
    held, train = split_holdout(vectors(spark, sf), HOLDOUT)
    test, valid = split_holdout(held, HOLDOUT // 2)
    model = SoftmaxTrainer(10, max_epochs=4, tranche_size=512).fit(train, valid, BANK)
    return E.accuracy(E.predict(znormalise(test), BANK, model))


def _file_of(spark: SparkSession, sf: str, separator: str) -> str:
    """The vectors as one headerless text file in the shared folder: label, then samples, in order of the id."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="series-")
    path = f"{root}/{uuid.uuid4().hex}"
    line = F.concat_ws(separator, F.col("label").cast("string"), F.concat_ws(separator, F.col("x").cast("array<string>")))
    vectors(spark, sf).orderBy("series_id").select(line.alias("value")).coalesce(1).write.text(path)
    return path


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def queries() -> dict:
    return {
        "series_scan": lambda s, d: unpack(vectors(s, d), "x", "v", "series_id", "label"),
        "events_to_series": lambda s, d: unpack(user_series(s, d), "x", "v", "series_id"),
        "split_validation": lambda s, d: split_holdout(vectors(s, d), HOLDOUT)[0].select("series_id", "label"),
        "split_training": lambda s, d: split_holdout(vectors(s, d), HOLDOUT)[1].select("series_id", "label"),
        "split_test": lambda s, d: vectors(s, d).where(F.col("series_id") < HOLDOUT // 2).select("series_id", "label"),
        "tranche_assign": lambda s, d: E.assign_tranches(vectors(s, d).select("series_id"), TRANCHE),
        "minibatch_assign": lambda s, d: E.assign_minibatches(E.assign_tranches(vectors(s, d).select("series_id"), TRANCHE), BATCH),
        "kernel_bank": lambda s, d: BANK.to_df(s).drop("weights"),
        "kernel_from_draws": lambda s, d: rounded(unpack(BANK.to_df(s), "weights", "w", "kernel_id", "length", "bias", "dilation", "padding"), 9, "w", "bias"),
        "series_text": lambda s, d: unpack(read_series_text(s, _file_of(s, d, "  ")), "x", "v", "series_id", "label"),
        "series_csv_range": lambda s, d: unpack(read_series_csv(s, _file_of(s, d, ","), HOLDOUT // 2, HOLDOUT), "x", "v", "series_id", "label"),
        "kernel_lengths_hist": lambda s, d: BANK.to_df(s).groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total")),
        "kernel_weights_flat": lambda s, d: unpack(BANK.to_df(s), "weights", "w", "kernel_id"),
        "kernel_span_max": lambda s, d: BANK.to_df(s).groupBy("length").agg(F.max((F.col("length") - 1) * F.col("dilation")).alias("span"), F.max("dilation").alias("dilation")),
        "kernel_output_length": q_output_length,
        "conv_positions": lambda s, d: positions(vectors(s, d), SMALL.to_df(s)).select("series_id", "kernel_id", "pos"),
        "conv_taps": q_conv_taps,
        "conv_response": lambda s, d: responses(vectors(s, d), SMALL.to_df(s)),
        "feature_max": lambda s, d: transform_sql(vectors(s, d), SMALL.to_df(s)).select("series_id", "kernel_id", "mx"),
        "feature_ppv": lambda s, d: transform_sql(vectors(s, d), SMALL.to_df(s)).select("series_id", "kernel_id", "ppv"),
        "transform_long": lambda s, d: transform_long(vectors(s, d).drop("label"), BANK),
        "transform_wide": lambda s, d: unpack(assemble_wide(transform_long(vectors(s, d), BANK)), "features", "v", "series_id"),
        "transform_events": lambda s, d: transform_long(znormalise(user_series(s, d)).drop("label"), EVENT_BANK),
        "series_znorm": lambda s, d: unpack(znormalise(vectors(s, d)), "x", "v", "series_id"),
        "series_mean_std": lambda s, d: series_stats(user_series(s, d)).select("series_id", "mean", "std"),
        "feature_scaler": lambda s, d: rounded(fit_feature_scaler(transform_long(vectors(s, d), BANK), HOLDOUT), 6, "ppv_mean", "ppv_std", "mx_mean", "mx_std"),
        "feature_standardised": lambda s, d: rounded(
            standardise(f := transform_long(znormalise(vectors(s, d)).drop("label"), BANK), fit_feature_scaler(f, HOLDOUT)), 6, "ppv", "mx"
        ),
        "linear_scores": lambda s, d: rounded(_scores(s, d), 6, "score"),
        "predict_argmax": lambda s, d: E.argmax_class(_scores(s, d)),
        "accuracy": lambda s, d: E.accuracy(_predictions(s, d)),
        "softmax_loss": lambda s, d: rounded(E.softmax_loss(_scores(s, d), _labels(s, d)), 6, "loss"),
        "lr_select": lambda s, d: E.select_rate(s.createDataFrame(RATES, "step int, lr double, loss double")),
        "early_stop_trace": lambda s, d: E.stop_trace(s.createDataFrame(LOSSES, "step int, val_loss double"), 2),
        "run_summary": lambda s, d: rounded(summarise_runs(results_frame(s, RUNS, RUNS_SCHEMA)), 6, "accuracy_mean", "accuracy_standard_deviation").drop("time_training_seconds", "time_test_seconds"),
        "timing_summary": lambda s, d: rounded(summarise_runs(results_frame(s, RUNS, RUNS_SCHEMA)), 6, "time_training_seconds", "time_test_seconds").drop("accuracy_mean", "accuracy_standard_deviation"),
        "results_union": lambda s, d: union_by_k({k: results_frame(s, r, SCALING_SCHEMA) for k, r in SCALING.items()}),
        "ridge_accuracy": q_ridge_accuracy,
        "softmax_accuracy": q_softmax_accuracy,
    }


VEC = "SELECT vec_id AS series_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"
FOLD = "lambda a, b: a + b"
EVT = f"""SELECT user_id AS series_id, list(value ORDER BY ts, event_id)[1:{EVENT_LENGTH}] AS x FROM events
GROUP BY user_id HAVING count(*) >= {EVENT_LENGTH}"""
NORMED = """stats AS (SELECT series_id, x, list_reduce(x, {f}) / len(x) AS m FROM s),
dev AS (SELECT series_id, x, m, sqrt(list_reduce(list_transform(x, lambda v: (v - m) * (v - m)), {f}) / len(x)) AS sd FROM stats),
z AS (SELECT series_id, list_transform(x, lambda v: CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0.0::DOUBLE END) AS x FROM dev)""".format(f=FOLD)


def _dot(x: str = "x") -> str:
    terms = " + ".join(
        f"CASE WHEN {j} < length AND pos + {j} * dilation >= 0 AND pos + {j} * dilation < len({x}) THEN weights[{j + 1}] * {x}[pos + {j} * dilation + 1] ELSE 0.0::DOUBLE END"
        for j in range(max(KERNEL_LENGTHS))
    )
    return f"bias + {terms}"


def _long(series: str, bank: str) -> str:
    """CTEs p (positions), r (responses), f (features) over the CTE ``series``."""
    return f"""b AS (SELECT * FROM {bank}),
p AS (SELECT series_id, x, b.*, unnest(range(-padding, len(x) + padding - (length - 1) * dilation))::INT AS pos FROM {series} CROSS JOIN b),
r AS (SELECT series_id, kernel_id, pos, {_dot()} AS resp FROM p),
f AS (SELECT series_id, kernel_id, count_if(resp > 0)::DOUBLE / count(*) AS ppv, max(resp) AS mx FROM r GROUP BY ALL)"""


def _values(rows: list[tuple], alias: str) -> str:
    lit = lambda v: f"'{v!r}'::DOUBLE" if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS {alias}"


#: What chance decided of ``BANK``; SQL derives the kernels from it.
DRAWS = "(VALUES {}) AS d(kernel_id, normals, u_bias, u_dilation, same)".format(
    ", ".join(f"({i}, [{', '.join(f"'{v!r}'::DOUBLE" for v in w.normals)}], '{w.bias!r}'::DOUBLE, '{w.dilation!r}'::DOUBLE, {w.same})" for i, w in enumerate(draw_kernels(len(BANK), SEED)))
)
#: Rows of the file: numbered from 0 in order of the id.
FILE = f"WITH s AS ({VEC}), n AS (SELECT row_number() OVER (ORDER BY series_id) - 1 AS series_id, label, x FROM s)"


def oracle_sql() -> dict[str, str]:
    bank, small, ebank = BANK.sql_values("k"), SMALL.sql_values("k"), EVENT_BANK.sql_values("k")
    vec = f"WITH s AS ({VEC})"
    full, raw = f"{vec}, {_long('s', bank)}", f"{vec}, {_long('s', small)}"
    zfull = f"{vec}, {NORMED}, {_long('z', bank)}"
    coef = _values(COEF, "c(class, kernel_id, w_ppv, w_mx, intercept)")
    scores = f"{zfull}, sc AS (SELECT series_id, class, sum(ppv * w_ppv + mx * w_mx) + first(intercept) AS score FROM f JOIN {coef} USING (kernel_id) GROUP BY ALL)"
    pred = f"{scores}, pr AS (SELECT series_id, arg_min(class, (-score, class)) AS prediction FROM sc GROUP BY ALL)"
    runs = _values(RUNS, "r(dataset, run, accuracy, t_tr_transform, t_te_transform, t_fit, t_score)")
    scal = " UNION ALL ".join(
        f"SELECT {k} AS k, num_training_examples::BIGINT AS num_training_examples, accuracy, time_training_seconds FROM {_values(r, f't{k}(num_training_examples, accuracy, time_training_seconds)')}"
        for k, r in SCALING.items()
    )
    agg = "SELECT kernel_id, round(avg(ppv), 6) AS ppv_mean, round(stddev_pop(ppv), 6) AS ppv_std, round(avg(mx), 6) AS mx_mean, round(stddev_pop(mx), 6) AS mx_std"
    return {
        "series_scan": f"{vec} SELECT series_id, label, i::INT - 1 AS i, x[i] AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM s)",
        "events_to_series": f"WITH s AS ({EVT}) SELECT series_id, i::INT - 1 AS i, x[i] AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM s)",
        "split_validation": f"SELECT vec_id AS series_id, label FROM embeddings WHERE vec_id < {HOLDOUT}",
        "split_training": f"SELECT vec_id AS series_id, label FROM embeddings WHERE vec_id >= {HOLDOUT}",
        "split_test": f"SELECT vec_id AS series_id, label FROM embeddings WHERE vec_id < {HOLDOUT // 2}",
        "tranche_assign": f"SELECT vec_id AS series_id, vec_id // {TRANCHE} AS tranche FROM embeddings",
        "minibatch_assign": f"""SELECT vec_id AS series_id, vec_id // {TRANCHE} AS tranche,
(row_number() OVER (PARTITION BY vec_id // {TRANCHE} ORDER BY (vec_id * 1103515245 + 12345) % 2147483648, vec_id) - 1) // {BATCH} AS minibatch FROM embeddings""",
        "kernel_bank": f"SELECT kernel_id, length, bias, dilation, padding FROM {bank}",
        "kernel_from_draws": f"""WITH d AS (SELECT *, len(normals) AS length FROM {DRAWS}),
k AS (SELECT *, greatest(1, floor(power(2, u_dilation * log2({LENGTH - 1}::DOUBLE / (length - 1)))))::INT AS dilation, list_reduce(normals, lambda a, b: a + b) / length AS mean FROM d)
SELECT kernel_id, length::INT AS length, i::INT - 1 AS i, round(normals[i] - mean, 9) AS w, round(2 * u_bias - 1, 9) AS bias, dilation, CASE WHEN same THEN (length - 1) * dilation // 2 ELSE 0 END::INT AS padding
FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM k)""",
        "series_text": f"{FILE} SELECT series_id, label, i::INT - 1 AS i, x[i] AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM n)",
        "series_csv_range": f"""{FILE} SELECT series_id, label, i::INT - 1 AS i, x[i] AS v
FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM n WHERE series_id >= {HOLDOUT // 2} AND series_id < {HOLDOUT // 2 + HOLDOUT})""",
        "kernel_lengths_hist": f"SELECT length, count(*) AS n, sum(length)::BIGINT AS total FROM {bank} GROUP BY length",
        "kernel_weights_flat": f"SELECT kernel_id, i::INT - 1 AS i, weights[i] AS w FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM {bank})",
        "kernel_span_max": f"SELECT length, max((length - 1) * dilation) AS span, max(dilation) AS dilation FROM {bank} GROUP BY length",
        "kernel_output_length": f"{vec} SELECT series_id, kernel_id, (len(x) + 2 * padding - (length - 1) * dilation)::BIGINT AS n FROM s CROSS JOIN {bank}",
        "conv_positions": f"{raw} SELECT series_id, kernel_id, pos FROM p",
        "conv_taps": f"""{raw}, t AS (SELECT *, unnest(range(0, length))::INT AS j FROM p)
SELECT series_id, kernel_id, pos, j, CASE WHEN pos + j * dilation >= 0 AND pos + j * dilation < len(x)
THEN weights[j + 1] * x[pos + j * dilation + 1] ELSE 0.0::DOUBLE END AS product FROM t""",
        "conv_response": f"{raw} SELECT series_id, kernel_id, pos, resp FROM r",
        "feature_max": f"{raw} SELECT series_id, kernel_id, mx FROM f",
        "feature_ppv": f"{raw} SELECT series_id, kernel_id, ppv FROM f",
        "transform_long": f"{full} SELECT series_id, kernel_id, ppv, mx FROM f",
        "transform_wide": f"{full} SELECT series_id, 2 * kernel_id AS i, ppv AS v FROM f UNION ALL SELECT series_id, 2 * kernel_id + 1, mx FROM f",
        "transform_events": f"WITH s AS ({EVT}), {NORMED}, {_long('z', ebank)} SELECT series_id, kernel_id, ppv, mx FROM f",
        "series_znorm": f"{vec}, {NORMED} SELECT series_id, i::INT - 1 AS i, x[i] AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM z)",
        "series_mean_std": f"WITH s AS ({EVT}), {NORMED} SELECT series_id, m AS mean, sd AS std FROM dev",
        "feature_scaler": f"{full} {agg} FROM f WHERE series_id < {HOLDOUT} GROUP BY kernel_id",
        "feature_standardised": f"""{zfull}, sc AS (SELECT kernel_id, avg(ppv) AS pm, stddev_pop(ppv) AS ps, avg(mx) AS mm, stddev_pop(mx) AS ms FROM f WHERE series_id < {HOLDOUT} GROUP BY kernel_id)
SELECT series_id, kernel_id, round((ppv - pm) / (ps + 1e-8), 6) AS ppv, round((mx - mm) / (ms + 1e-8), 6) AS mx FROM f JOIN sc USING (kernel_id)""",
        "linear_scores": f"{scores} SELECT series_id, class, round(score, 6) AS score FROM sc",
        "predict_argmax": f"{pred} SELECT series_id, prediction FROM pr",
        "accuracy": f"{pred} SELECT avg((prediction = label % {CLASSES})::INT::DOUBLE) AS accuracy FROM pr JOIN s USING (series_id)",
        "softmax_loss": f"""{scores}, top AS (SELECT series_id, max(score) AS top FROM sc GROUP BY ALL),
l AS (SELECT series_id, ln(sum(exp(score - top))) + first(top) AS lse FROM sc JOIN top USING (series_id) GROUP BY ALL)
SELECT round(avg(lse - score), 6) AS loss FROM l JOIN s USING (series_id) JOIN sc ON sc.series_id = l.series_id AND sc.class = s.label % {CLASSES}""",
        "lr_select": f"SELECT lr, loss FROM {_values(RATES, 't(step, lr, loss)')} ORDER BY loss, step LIMIT 1",
        "early_stop_trace": f"""WITH RECURSIVE t AS (SELECT * FROM {_values(LOSSES, 'v(step, val_loss)')}),
w AS (SELECT 0 AS step, NULL::DOUBLE AS val_loss, 'inf'::DOUBLE AS best, 0 AS stalls, false AS stopped
UNION ALL SELECT t.step, t.val_loss, CASE WHEN t.val_loss >= w.best THEN w.best ELSE t.val_loss END,
CASE WHEN t.val_loss >= w.best THEN w.stalls + 1 WHEN w.stopped THEN w.stalls ELSE 0 END,
w.stopped OR (t.val_loss >= w.best AND w.stalls + 1 >= 2) FROM w JOIN t ON t.step = w.step + 1)
SELECT step, val_loss, best, stalls, stopped FROM w WHERE step > 0""",
        "run_summary": f"SELECT dataset, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_standard_deviation FROM {runs} GROUP BY dataset",
        "timing_summary": f"SELECT dataset, round(avg(t_tr_transform) + avg(t_fit), 6) AS time_training_seconds, round(avg(t_te_transform) + avg(t_score), 6) AS time_test_seconds FROM {runs} GROUP BY dataset",
        "results_union": scal,
    }
