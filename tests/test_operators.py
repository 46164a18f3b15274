import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge import make_kernels, transform_long, transform_sql, transform_wide
from seriesforge.functions.sql_surface import register_kernel_transform
from seriesforge.operators import evaluate as E
from seriesforge.operators.normalise import znormalise
from seriesforge.operators.ridge import fit_ridge, loo_errors, spectrum
from seriesforge.operators.softmax import LEARNING_RATES, Plateau, SoftmaxTrainer, StopRule, cross_entropy
from seriesforge.operators.transform import assemble_wide
from seriesforge.streaming import transform_stream


def frame(spark, x, y=None, parts=3):
    y = [0] * len(x) if y is None else y
    rows = [(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "series_id long, label int, x array<double>").repartition(parts)


def classes(n, length=64, kinds=2, seed=0):
    rng = np.random.default_rng(seed)
    t, y = np.arange(length), rng.integers(0, kinds, n)
    phase = rng.uniform(0, 6.28, (n, 1))
    wave = np.sin(t[None, :] * (0.2 + 0.25 * y[:, None]) + phase)
    return wave + rng.normal(0, 0.1, (n, length)), y


def test_plans_agree_and_partitions_do_not_matter(spark):
    x = np.random.default_rng(1).normal(size=(7, 30))
    bank = make_kernels(30, 5, 3)
    got = {(r.series_id, r.kernel_id): (r.ppv, r.mx) for r in transform_long(frame(spark, x), bank).collect()}
    assert got == {(r.series_id, r.kernel_id): (r.ppv, r.mx) for r in transform_sql(frame(spark, x, parts=1), bank.to_df(spark)).collect()}
    wide = {r.series_id: r.features for r in transform_wide(frame(spark, x, parts=9), bank).collect()}
    assert wide == {r.series_id: r.features for r in assemble_wide(transform_long(frame(spark, x), bank)).collect()}


def test_transform_has_no_shuffle_and_prunes_columns(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("series_id"), F.col("embedding").alias("x"))
    plan = transform_long(df, make_kernels(64, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "label" not in plan


def test_empty_and_null_input(spark):
    bank = make_kernels(20, 2, 1)
    empty = spark.createDataFrame([], "series_id long, label int, x array<double>")
    assert transform_long(empty, bank).count() == 0 and transform_sql(empty, bank.to_df(spark)).count() == 0
    with pytest.raises(Exception, match="null or does not have"):
        transform_long(spark.createDataFrame([(1, None)], "series_id long, x array<double>"), bank).count()


def test_constant_series_normalise_to_zeros(spark):
    got = {r.series_id: r.x for r in znormalise(frame(spark, [[2.0] * 4, [1, 2, 3, 4]])).collect()}
    assert got[0] == [0.0] * 4 and abs(sum(got[1])) < 1e-12 and abs(np.std(got[1]) - 1) < 1e-12


@pytest.mark.parametrize(("n", "p"), [(12, 30), (30, 8)])
def test_loo_formula_equals_leaving_out(n, p):
    rng = np.random.default_rng(n)
    z, y = rng.normal(size=(n, p)), rng.choice([-1.0, 1.0], (n, 1))
    z -= z.mean(axis=0)
    for alpha in (1e-2, 1.0, 100.0):
        rest = []
        for i in range(n):
            keep = np.arange(n) != i
            zm, ym = z[keep].mean(axis=0), y[keep].mean()
            w = np.linalg.solve((z[keep] - zm).T @ (z[keep] - zm) + alpha * np.eye(p), (z[keep] - zm).T @ (y[keep] - ym))
            rest.append(y[i] - ym - (z[i] - zm) @ w)
        assert np.isclose(loo_errors(*spectrum(z @ z.T), y, (alpha,))[alpha], np.mean(np.square(rest)), rtol=1e-6)


@pytest.mark.parametrize(("n", "kinds", "k"), [(80, 2, 60), (400, 3, 20)])
def test_ridge_learns_on_both_routes(spark, n, kinds, k):
    x, y = classes(n, kinds=kinds)
    bank = make_kernels(64, k, 5)
    model = fit_ridge(frame(spark, x, y), bank)
    tx, ty = classes(120, kinds=kinds, seed=9)
    assert E.accuracy(E.predict(frame(spark, tx, ty), bank, model)).first()[0] > 0.9
    assert model.alpha == min(model.loo_mse, key=model.loo_mse.get)


def test_ridge_routes_agree(spark, monkeypatch):
    from seriesforge.operators import ridge

    x, y = classes(50, kinds=3)
    bank, df = make_kernels(64, 10, 5), frame(spark, x, y)
    a, b = (f(df, bank, ridge.ALPHAS, 4) for f in (ridge._fit_kernels, ridge._fit_rows))
    assert a.alpha == b.alpha and np.allclose(a.coef, b.coef, atol=1e-6) and np.allclose(a.intercept, b.intercept, atol=1e-6)
    assert all(np.isclose(a.loo_mse[v], b.loo_mse[v], rtol=1e-6) for v in ridge.ALPHAS)


@pytest.mark.parametrize(("rows", "kernels"), [(50, 40), (90, 10)])
def test_ridge_gathered_equals_distributed(spark, monkeypatch, rows, kernels):
    from seriesforge.operators import ridge

    x, y = classes(rows, kinds=3)
    bank, df = make_kernels(64, kernels, 5), frame(spark, x, y)
    a = ridge.fit_ridge(df, bank)
    monkeypatch.setattr(ridge, "MAX_GATHERED", 0)
    b = ridge.fit_ridge(df, bank)
    assert a.alpha == b.alpha and np.allclose(a.coef, b.coef, atol=1e-6) and np.allclose(a.intercept, b.intercept, atol=1e-6)
    assert all(np.isclose(a.loo_mse[v], b.loo_mse[v], rtol=1e-6) for v in ridge.ALPHAS)


def test_softmax_trainer_learns(spark):
    x, y = classes(1200, kinds=3)
    valid, train = frame(spark, x[:200], y[:200]), frame(spark, x, y).where("series_id >= 200")
    bank = make_kernels(64, 40, 2)
    model = SoftmaxTrainer(3, tranche_size=512, max_epochs=6).fit(train, valid, bank)
    assert E.accuracy(E.predict(znormalise(valid), bank, model)).first()[0] > 0.9 and model.history


def test_softmax_reads_tranches_again_beyond_its_cache(spark):
    x, y = classes(700, kinds=3)
    valid, train = frame(spark, x[:100], y[:100]), frame(spark, x, y).where("series_id >= 100 and not series_id between 228 and 355")  # an empty tranche
    bank = make_kernels(64, 12, 2)
    a, b = (SoftmaxTrainer(3, tranche_size=128, minibatch_size=64, max_epochs=3, cache_bytes=c).fit(train, valid, bank) for c in (1 << 30, 20_000))
    assert (a.weights == b.weights).all() and a.weights.dtype == np.float32 and a.history == b.history
    with pytest.raises(ValueError):
        SoftmaxTrainer(3, cache_bytes=100).fit(train, valid, bank)


def test_minibatches_leave_out_the_undersized():
    rows = {0: (None, np.zeros(10)), 1: (None, np.zeros(0)), 2: (None, np.zeros(3))}
    got = [(e, len(r[1]), len(p)) for e, r, p in SoftmaxTrainer(2, minibatch_size=4, max_epochs=2).minibatches(3, rows.get)]
    assert got == [(e, n, k) for e in range(2) for n, k in ((10, 4), (10, 4), (3, 3))]


def test_stop_rule_and_rate_choice():
    rule = StopRule(2)
    assert [rule.check(v) for v in (2.0, 1.5, 1.5, 1.25, 1.25, 1.5, 1.0)] == [False, False, False, False, False, True, True]
    assert rule.best == 1.0
    p = Plateau(patience=1)
    lr = 1.0
    for v in (1.0, 1.0, 1.0, 0.5):
        lr = p.step(v, lr)
    assert lr == 0.5
    x, y = np.eye(3), np.arange(3)
    assert SoftmaxTrainer(3).search_rate((x, y), (x, y)) == LEARNING_RATES[0]
    assert np.isclose(cross_entropy(np.zeros((2, 4)), np.array([0, 3])), np.log(4))


def test_streaming_transform_equals_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("series_id"), F.col("embedding").cast("array<double>").alias("x"))
    src.write.parquet(str(tmp_path / "in"))
    bank = make_kernels(64, 3, 7)
    stream = transform_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), bank)
    q = stream.writeStream.format("memory").queryName("feats").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("feats").exceptAll(transform_long(znormalise(src), bank)).count() == 0 and spark.table("feats").count() == 3 * src.count()


def test_sql_table_function_equals_transform(spark):
    bank = make_kernels(30, 3, 3)
    df = frame(spark, np.random.default_rng(1).normal(size=(4, 30)))
    df.createOrReplaceTempView("series")
    register_kernel_transform(spark, bank)
    got = spark.sql("SELECT s.series_id, t.kernel_id, t.ppv, t.mx FROM series s, LATERAL kernel_transform(s.x) t")
    assert got.exceptAll(transform_long(df.drop("label"), bank)).count() == 0 and got.count() == 12
