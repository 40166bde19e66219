"""Mini-batch steps against a plain loop."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonescale import session
from tonescale.operators import minibatch

SIZE, DIMS = 5, ("V", "A", "D")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(331, SIZE))
    y = 3 + x @ rng.normal(scale=0.3, size=(SIZE, 3)) + rng.normal(scale=0.2, size=(331, 3))
    rows = [(i, "train" if i % 5 else "val", x[i].tolist(), *map(float, y[i])) for i in range(331)]
    rows += [(1000, "train", None, 1.0, 1.0, 1.0), (1001, "train", [0.0] * SIZE, None, 1.0, 1.0), (1002, "test", [0.0] * SIZE, 1.0, 1.0, 1.0)]
    schema = "id long, split string, features array<double>, V double, A double, D double"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def plain(table, workers, epochs, rate, batch=16, joint=True):
    pdf = table.filter("features is not null and V is not null and split <> 'test'").toPandas().sort_values("id")
    x, y, ids = np.stack(pdf.features), pdf[list(DIMS)].to_numpy() / 5, pdf.id.to_numpy()
    train = (pdf.split == "train").to_numpy()
    mean, spread = x[train].mean(0), x[train].std(0, ddof=1)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    w, m, v, step = np.zeros((3, SIZE + 1)), np.zeros((3, SIZE + 1)), np.zeros((3, SIZE + 1)), 0
    w[:, 0] = y[train].mean(0)
    shard = np.array([int(md5(f"42-{i}")[:8], 16) % workers for i in ids])
    log = []
    for epoch in range(1, epochs + 1):
        ends, seen = [], []
        for s in range(workers):
            own = [r for r in np.flatnonzero(train & (shard == s))]
            own.sort(key=lambda r: md5(f"42-{epoch}-{ids[r]}"))
            sw, sm, sv, st = w, m, v, step
            for at in range(0, len(own), batch):
                rows = own[at : at + batch]
                e = z[rows] @ sw.T - y[rows]
                seen.append(np.where(abs(e) < 1, 0.5 * e * e, abs(e) - 0.5).mean(0))
                g = np.clip(e, -1, 1).T @ z[rows] / (len(rows) * (3 if joint else 1))
                st += 1
                sm, sv = 0.9 * sm + 0.1 * g, 0.999 * sv + 0.001 * g * g
                sw = sw - rate * (sm / (1 - 0.9**st)) / (np.sqrt(sv / (1 - 0.999**st)) + 1e-8)
            if own:
                ends.append((len(own), sw, sm, sv, st))
        total = sum(n for n, *_ in ends)
        w, m, v = (sum(n * s[i] for n, *s in ends) / total for i in range(3))
        step = max(st for *_, st in ends)
        e = z[~train] @ w.T - y[~train]
        loss = np.where(abs(e) < 1, 0.5 * e * e, abs(e) - 0.5)
        val = np.mean([loss[i : i + 16].mean(0) for i in range(0, len(loss), 16)], axis=0)
        log.append((np.mean(seen, axis=0), val, w))
    return mean, spread, log


@pytest.mark.parametrize("workers, batch", [(1, 16), (2, 16), (7, 16), (3, 1), (400, 5)])
def test_steps_equal_a_plain_loop(table, workers, batch):
    fitted = minibatch.fit_minibatches(table, SIZE, epochs=2, rate=0.01, workers=workers, batch=batch)
    mean, spread, log = plain(table, workers, 2, 0.01, batch)
    got = [(r.train_loss, r.val_loss) for r in fitted.losses.orderBy("epoch").collect()]
    assert np.allclose(got, [(a.mean(), b.mean()) for a, b, _ in log], atol=1e-10)
    w = min(log, key=lambda row: row[1].mean())[2]
    assert np.allclose(fitted.model.weights, w[:, 1:] / spread, atol=1e-10)


def test_dimensions_stop_on_their_own(table):
    fitted = minibatch.fit_minibatches(table, SIZE, epochs=6, rate=0.3, workers=2, patience=1, joint=False)
    _, _, log = plain(table, 2, 6, 0.3, joint=False)
    rows = fitted.losses.collect()
    for k, d in enumerate(DIMS):
        val = [b[k] for _, b, _ in log]
        stop = next((e for e in range(1, 6) if val[e] >= min(val[:e])), 5)
        own = sorted((r.epoch, r.val_loss) for r in rows if r.run == d)
        assert [e for e, _ in own] == list(range(1, stop + 2)) and np.allclose([x for _, x in own], val[: stop + 1], atol=1e-9)


def test_an_epoch_is_one_job_without_a_shuffle_of_rows(table, spark, monkeypatch):
    plans, jobs = [], []
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    whole = minibatch.epoch_of_steps

    def watched(*args, **more):
        context.setJobGroup(f"epoch-{len(jobs)}", "steps of one epoch")
        try:
            return whole(*args, **more)
        finally:
            jobs.append(len(tracker.getJobIdsForGroup(f"epoch-{len(jobs)}")))
            context.setLocalProperty("spark.jobGroup.id", None)
            placed = args[0].sortWithinPartitions("shard").groupBy("shard").applyInArrow(lambda b: b, args[0].schema)
            plans.append(placed._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(minibatch, "epoch_of_steps", watched)
    minibatch.fit_minibatches(table, SIZE, epochs=3, rate=0.01, workers=4)
    # Adaptive execution submits the shuffle and the result of one query as two jobs.
    assert all(n <= 2 for n in jobs) and len(jobs) == 3
    assert all("Exchange" not in p and "Bucketed: true" in p for p in plans)


def test_nothing_is_left_and_no_training_rows_are_refused(table, spark):
    made = session._made.setdefault(spark.sparkContext.applicationId, [])
    before, tables = list(made), spark.catalog.listTables()
    minibatch.fit_minibatches(table, SIZE, epochs=1, workers=2)
    with pytest.raises(ValueError, match="training row"):
        minibatch.fit_minibatches(table.withColumn("split", F.lit("val")), SIZE, epochs=1)
    assert made == before and spark.catalog.listTables() == tables
