import numpy as np
import pytest
from pyspark.sql import functions as F

from tonescale.operators import features, fit, metrics, monitor, score
from tonescale.plans import jobs

SIZE = 6
DIMS = ("V", "A", "D")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, SIZE))
    y = 3 + x @ rng.normal(scale=0.3, size=(SIZE, 3)) + rng.normal(scale=0.2, size=(300, 3))
    rows = [(i, "train" if i % 5 else "val", x[i].tolist(), *map(float, y[i])) for i in range(300)]
    rows += [(1000, "train", None, 1.0, 1.0, 1.0), (1001, "train", [0.0] * SIZE, None, 1.0, 1.0)]
    schema = "id long, split string, features array<double>, V double, A double, D double"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def matrices(table):
    pdf = table.filter("features is not null and V is not null").toPandas()
    return pdf, np.stack(pdf.features), pdf[list(DIMS)].to_numpy()


def test_cross_products(table):
    _, x, y = matrices(table)
    z = np.hstack([np.ones((len(x), 1)), x, y[:, :2]])
    cells = {(r.i, r.j): r.value for r in fit.cross_products(table, SIZE, ["V", "A"]).collect()}
    full = z.T @ z
    assert len(cells) == 9 * 10 // 2
    assert all(cells[i, j] == pytest.approx(full[i, j], abs=1e-8) for i, j in cells)


@pytest.mark.parametrize("tile", [1, 4, 100])
def test_wide_products_in_tiles(table, tile):
    whole = {(r.i, r.j): r.value for r in fit.cross_products(table, SIZE, ["V"]).collect()}
    tiled = {(r.i, r.j): r.value for r in fit.cross_products(table, SIZE, ["V"], tile=tile).collect()}
    assert tiled.keys() == whole.keys() and all(tiled[c] == pytest.approx(whole[c]) for c in whole)


def test_long_table_in_one_pass(table):
    """Each dimension is fitted on its own rows, as separate fits do."""
    wide = table.withColumn("A", F.when(F.col("id") % 3 != 0, F.col("A")))
    long = wide.unpivot(["features"], list(DIMS), "dim", "value")
    found = fit.fit_long(long, SIZE, reg=0.05)
    for at, dim in enumerate(DIMS):
        single = fit.fit_single(wide, dim, reg=0.05)
        assert np.allclose(found.weights[at], single.coefficients.toArray(), atol=1e-9)
        assert found.intercepts[at] == pytest.approx(single.intercept, abs=1e-9)


def test_joint_and_separate_fits_agree(table):
    joint = fit.fit_multi(table, SIZE, reg=0.05)
    for at, dim in enumerate(DIMS):
        single = fit.fit_single(table.filter("V is not null"), dim, reg=0.05)
        assert np.allclose(joint.weights[at], single.coefficients.toArray(), atol=1e-10)
        assert joint.intercepts[at] == pytest.approx(single.intercept, abs=1e-10)


def test_least_squares_without_penalty(table):
    _, x, y = matrices(table)
    z = np.hstack([np.ones((len(x), 1)), x])
    want = np.linalg.lstsq(z, y / 5, rcond=None)[0]
    model = fit.fit_multi(table, SIZE, reg=0.0)
    assert np.allclose(model.weights, want[1:].T) and np.allclose(model.intercepts, want[0])


def test_constant_target_gets_no_weights(table):
    model = fit.fit_multi(table.withColumn("V", F.lit(4.0)), SIZE, ["V"])
    assert np.allclose(model.weights, 0.0) and model.intercepts[0] == pytest.approx(0.8)


def test_nothing_to_fit_on(table):
    with pytest.raises(ValueError, match="no complete row"):
        fit.fit_multi(table.filter("false"), SIZE)


def reference_epochs(table, epochs, parts, rate):
    """The same steps in plain numpy."""
    import hashlib

    pdf, x, y = matrices(table)
    y = y / 5
    train, val = (pdf.split == "train").to_numpy(), (pdf.split == "val").to_numpy()
    mean, spread = x[train].mean(0), x[train].std(0, ddof=1)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    w = np.zeros((3, SIZE + 1))
    w[:, 0] = y[train].mean(0)
    m, v, step, log = 0.0, 0.0, 0, []
    order = pdf[val].sort_values("id").index
    folds = fit.FOLDS_PER_BATCH * parts
    fold = np.array([int(hashlib.md5(f"0-{i}".encode()).hexdigest()[:8], 16) % folds for i in pdf.id])
    for epoch in range(1, epochs + 1):
        ranked = sorted(range(folds), key=lambda f: hashlib.md5(f"42-{epoch}-{f}".encode()).hexdigest())
        rank = np.array([ranked.index(f) for f in fold])
        seen = []
        for k in range(parts):
            rows = train & (rank % parts == k)
            e = z[rows] @ w.T - y[rows]
            seen.append(np.where(abs(e) < 1, 0.5 * e * e, abs(e) - 0.5).mean())
            g = np.clip(e, -1, 1).T @ z[rows] / (rows.sum() * 3)
            if parts == 1:
                g[abs(g[:, 0]) < 1e-9 * abs(g).max(1), 0] = 0.0
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        e = z[order] @ w.T - y[order]
        loss = np.where(abs(e) < 1, 0.5 * e * e, abs(e) - 0.5).mean(1)
        log.append((np.mean(seen), np.mean([loss[i : i + 16].mean() for i in range(0, len(loss), 16)])))
    return w, mean, spread, log


@pytest.mark.parametrize("parts", [1, 3])
def test_epochs_equal_numpy(table, parts):
    fitted = fit.fit_epochs(table, SIZE, epochs=3, batches_per_epoch=parts, rate=0.01)
    w, mean, spread, log = reference_epochs(table, 3, parts, 0.01)
    got = [(r.train_loss, r.val_loss) for r in fitted.losses.orderBy("epoch").collect()]
    assert np.allclose(got, log, atol=1e-10)
    assert log[-1][1] == min(v for _, v in log)
    assert np.allclose(fitted.model.weights, w[:, 1:] / spread, atol=1e-10)


def test_epochs_stop_and_keep_the_best(table):
    fitted = fit.fit_epochs(table, SIZE, epochs=12, batches_per_epoch=2, rate=0.4, patience=2)
    losses = fitted.losses.orderBy("epoch").toPandas()
    log = fitted.losses.select("run", "epoch", F.col("val_loss").alias("loss"))
    (stop,) = monitor.early_stopping(log, patience=2).collect()
    assert stop.stopped_early and stop.epochs_run == len(losses) < 12
    # Scoring with the kept weights gives back the loss of the best epoch.
    val = table.filter("split = 'val'")
    scored = score.score_features(val, fitted.model)
    error = [F.col(f"{d}_pred") / 5 - F.col(d) / 5 for d in DIMS]
    assert scored.count() == 60
    from tonescale.operators import position

    placed = position.with_position(scored.select("id", *[e.alias(f"e{k}") for k, e in enumerate(error)]), ["id"])
    placed = placed.withColumn("batch_id", position.batch_of("pos")).withColumn("zero", F.lit(0.0))
    batches = metrics.batch_losses(placed, [("zero", f"e{k}") for k in range(3)])
    assert metrics.epoch_loss(batches).first().loss == pytest.approx(stop.best_loss, abs=1e-9)


def test_epochs_one_run_per_dimension(table):
    fitted = fit.fit_epochs(table, SIZE, epochs=6, batches_per_epoch=2, rate=0.4, patience=1, joint=False)
    log = fitted.losses.select("run", "epoch", F.col("val_loss").alias("loss"))
    stops = {r.run: r for r in monitor.early_stopping(log, patience=1).collect()}
    counts = {r.run: r["count"] for r in fitted.losses.groupBy("run").count().collect()}
    assert set(counts) == set(DIMS) and all(stops[d].epochs_run == counts[d] for d in DIMS)


def test_epochs_beat_the_mean(table):
    fitted = fit.fit_epochs(table, SIZE, epochs=4, batches_per_epoch=4, rate=0.02)
    val = table.filter("split = 'val'")
    means = table.filter("split = 'train'").agg(*[F.avg(d).alias(d) for d in DIMS]).first()
    flat = val.agg(*[F.avg(((F.col(d) - means[d]) / 5) ** 2 / 2) for d in DIMS]).first()
    assert fitted.losses.agg(F.min("val_loss")).first()[0] < np.mean(list(flat))


def test_score_and_storage(spark, table, tmp_path):
    model = fit.fit_multi(table, SIZE, encoder=features.HashedTerms(SIZE))
    model.save(spark, str(tmp_path / "model"))
    again = score.LinearWeights.load(spark, str(tmp_path / "model"))
    assert again.dims == model.dims and np.array_equal(again.weights, model.weights)
    assert again.encoder == model.encoder
    pdf, x, _ = matrices(table)
    got = score.score_features(table, again).toPandas().set_index("id")
    want = (x @ model.weights.T + model.intercepts) * 5
    assert np.allclose(got.loc[pdf.id, ["V_pred", "A_pred", "D_pred"]], want)
    assert got.loc[1000, ["V_pred", "A_pred", "D_pred"]].isna().all()


def test_single_models_are_stored_by_spark_ml(table, tmp_path):
    from pyspark.ml.regression import LinearRegressionModel

    model = fit.fit_single(table, "V")
    model.write().overwrite().save(str(tmp_path / "v"))
    again = LinearRegressionModel.load(str(tmp_path / "v"))
    assert np.array_equal(again.coefficients.toArray(), model.coefficients.toArray())


def test_missing_text_keeps_the_other_rows_in_place(spark):
    texts = [(1, "good good day"), (2, None), (3, "bad day"), (4, "good"), (5, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    labelled = spark.createDataFrame(
        [(i, t, "train", 1.0 + 2 * t.count("good"), 3.0, 2.0) for i, t in enumerate(["good", "bad", "good good", "day bad", "x y"])],
        "id long, text string, split string, V double, A double, D double",
    )
    model = jobs.train_joint(labelled, size=32, reg=0.001)
    rows = {r.id: r for r in jobs.predict(df, model).collect()}
    assert len(rows) == 5 and rows[2].V_pred is None and rows[2].D_pred is None
    assert rows[1].V_pred > rows[4].V_pred > rows[3].V_pred
    assert rows[5].text == "" and rows[5].V_pred is not None
    separate = jobs.train_single(labelled, features.HashedTerms(32), reg=0.001)
    assert np.allclose(separate.weights, model.weights, atol=1e-9)


def test_empty_table_is_refused(spark):
    model = score.LinearWeights(DIMS, np.zeros((3, 8)), np.zeros(3), features.HashedTerms(8))
    with pytest.raises(ValueError, match="nothing to score"):
        jobs.predict(spark.createDataFrame([], "id long, text string"), model)


def test_hashed_terms(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, None), (3, "")], "id long, text string")
    rows = {r.id: r.features for r in features.HashedTerms(16).transform(df).collect()}
    assert sorted(x for x in rows[1] if x) == pytest.approx(sorted([np.log(3), np.log(2)]))
    assert rows[2] is None and not any(rows[3])
    raw = features.HashedTerms(16, log=False).transform(df).filter("id = 1").first().features
    assert sum(raw) == 3.0


def test_stored_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<float>")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    rows = {r.id: r.features for r in features.StoredVectors(table).transform(df).collect()}
    assert rows == {1: [1.0, 2.0], 2: None}


def test_supplied_encoder(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=float)

    df = spark.createDataFrame([(1, "banana"), (2, None), (3, "x")], "id long, text string")
    rows = {r.id: r.features for r in features.BatchEncoder(make, batch_size=2).transform(df).collect()}
    assert rows == {1: [6.0, 3.0], 2: None, 3: [1.0, 0.0]}


def test_epochs_leave_no_scratch_tables(table, spark, tmp_path):
    from tonescale import session

    made = session._made.setdefault(spark.sparkContext.applicationId, [])
    before = list(made)
    fit.fit_epochs(table, SIZE, epochs=1, batches_per_epoch=2)
    with pytest.raises(ValueError, match="training row"):
        fit.fit_epochs(table.withColumn("split", F.lit("val")), SIZE, epochs=1)
    assert made == before
