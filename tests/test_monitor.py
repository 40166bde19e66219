import math
import random

import pytest

from tonescale.operators import monitor

NAN = float("nan")


def loop(losses, patience=3, max_epochs=None):
    """The plain loop: (epochs run, stopped early, best epoch)."""
    best, best_epoch, waited = math.inf, None, 0
    limit = len(losses) if max_epochs is None else min(len(losses), max_epochs)
    for epoch in range(1, limit + 1):
        if losses[epoch - 1] < best:
            best, best_epoch, waited = losses[epoch - 1], epoch, 0
        else:
            waited += 1
            if waited >= patience:
                return epoch, True, best_epoch
    return limit, False, best_epoch


CASES = {
    "recorded": [0.0057, 0.0041, 0.0038, 0.0035, 0.0037, 0.0034, 0.0032, 0.0031],
    "equal": [1.0, 1.0, 1.0, 1.0, 0.5],
    "nan_first": [NAN, 0.9, 0.8, 1.0],
    "nan_only": [NAN, NAN, NAN, NAN],
    "three_bad": [1.0, 2.0, 2.0, 2.0, 0.1],
    "two_bad": [1.0, 2.0, 2.0, 0.9, 2.0, 2.0],
    "short": [3.0, 2.0],
    "one": [3.0],
}


def test_cases_and_random_runs_equal_the_loop(spark):
    rng = random.Random(0)
    runs = dict(CASES)
    runs |= {f"random{i}": [rng.choice([0.1, 0.2, 0.3, 0.4, NAN]) for _ in range(rng.randint(1, 15))] for i in range(60)}
    rows = [(run, e, x) for run, losses in runs.items() for e, x in enumerate(losses, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, epoch int, loss double")
    for patience, limit in ((3, None), (2, None), (3, 5)):
        got = {
            r.run: (r.epochs_run, r.stopped_early, r.best_epoch)
            for r in monitor.early_stopping(df, patience, limit).collect()
        }
        assert got == {run: loop(losses, patience, limit) for run, losses in runs.items()}


def test_recorded_run_is_not_stopped(spark):
    rows = [("r", e, x) for e, x in enumerate(CASES["recorded"], 1)]
    (row,) = monitor.early_stopping(spark.createDataFrame(rows, "run string, epoch int, loss double")).collect()
    assert (row.epochs_run, row.stopped_early, row.best_epoch) == (8, False, 8)
    assert row.best_loss == pytest.approx(0.0031)


def test_one_shuffle_for_all_runs(spark):
    df = spark.createDataFrame([("r", 1, 1.0)], "run string, epoch int, loss double")
    plan = monitor.early_stopping(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
