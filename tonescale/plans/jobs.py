"""The jobs a user runs: prepare, train, predict, evaluate, compare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonescale.functions import DIMENSIONS
from tonescale.operators.align import Order, align, choose_key
from tonescale.operators.clean import auto_unscale, clean_annotated, require_columns
from tonescale.operators.features import FEATURES, HashedTerms
from tonescale.operators.fit import EpochFit, fit_epochs, fit_long, fit_multi
from tonescale.operators.metrics import evaluate, evaluate_pairs
from tonescale.operators.minibatch import fit_minibatches
from tonescale.operators.report import compare_runs, last_sections, parse_sections, parse_single, report_lines
from tonescale.operators.score import LinearWeights, refuse_empty, score
from tonescale.operators.split import split_exact, to_long
from tonescale.operators.wide import fit_wide, fit_wide_long


def prepare_single(
    dev: DataFrame, test: DataFrame | None = None, fraction: float = 0.8, seed: int = 42, key: str = "id"
) -> DataFrame:
    """One long table ``(key, text, split, dim, value)`` for separate fits: train, val and, held out, test."""
    columns = [key, "text", *DIMENSIONS]
    parts = split_exact(clean_annotated(dev.select(*columns)), key, fraction, seed, "round")
    if test is not None:
        held_out = clean_annotated(test.select(*columns)).withColumn("split", F.lit("test"))
        parts = parts.unionByName(held_out)
    return to_long(parts, keep=(key, "text", "split"))


def prepare_joint(dev: DataFrame, fraction: float = 0.8, seed: int = 42, key: str = "id") -> DataFrame:
    """The complete rows with a ``split`` column for a joint fit: train and val."""
    return split_exact(clean_annotated(dev), key, fraction, seed, "ceil")


def train_single(
    df: DataFrame, encoder=None, dims: Sequence[str] = DIMENSIONS, reg: float = 0.01, size: int | None = None, solver: str = "products"
) -> LinearWeights:
    """Least squares, one fit per dimension, on the ``train`` rows of a table with ``split``.

    The table is long (``dim``, ``value``), as ``prepare_single`` makes it, or has a column per dimension. All fits come
    from one pass of cross products, or, with ``solver="gradients"`` and for any number of features, from a pass for
    each step. ``size`` is the length of the features, for an encoder that does not tell.
    """
    encoder = encoder or HashedTerms()
    encoded = encoder.transform(df.filter(F.col("split") == "train"))
    if not {"dim", "value"} <= set(df.columns):
        encoded = to_long(encoded, dims, keep=(FEATURES,))
    fit = {"products": fit_long, "gradients": fit_wide_long}[solver]
    return fit(encoded, size or encoder.size, dims, reg, encoder=encoder)


def train_joint(
    df: DataFrame, size: int | None = None, encoder=None, dims: Sequence[str] = DIMENSIONS, reg: float = 0.01, solver: str = "products"
) -> LinearWeights:
    """Least squares, all dimensions together, on the ``train`` rows of a table with ``split``.

    ``solver`` is ``products`` (one pass, a matrix of features by features) or ``gradients`` (a pass for each step, no
    such matrix). ``size`` is the length of the features, for an encoder that does not tell; 256 without an encoder.
    """
    encoder = encoder or HashedTerms(size or 256)
    fit = {"products": fit_multi, "gradients": fit_wide}[solver]
    return fit(encoder.transform(df.filter(F.col("split") == "train")), size or encoder.size, dims, reg, encoder=encoder)


def train_epochs(df: DataFrame, size: int = 256, encoder=None, **settings) -> EpochFit:
    """Epoch-wise smooth-L1 fit with early stopping on a table with ``split``."""
    encoder = encoder or HashedTerms(size)
    return fit_epochs(encoder.transform(df), size, encoder=encoder, **settings)


def train_minibatches(df: DataFrame, size: int = 256, encoder=None, **settings) -> EpochFit:
    """Mini-batches of few rows each, stepped through by several workers side by side, on a table with ``split``."""
    encoder = encoder or HashedTerms(size)
    return fit_minibatches(encoder.transform(df), size, encoder=encoder, **settings)


def predict(df: DataFrame, model: LinearWeights, encoder=None) -> DataFrame:
    """Score a non-empty table of texts; every row keeps its columns, a missing text gets NULL predictions."""
    return score(refuse_empty(require_columns(df, "text")), model, encoder)


def evaluate_run(
    preds: DataFrame,
    gold: DataFrame,
    how: str = "auto",
    rescale: bool = False,
    order_preds: Order | None = None,
    order_gold: Order | None = None,
    dims: Sequence[str] | None = None,
) -> DataFrame:
    """Metrics per dimension. On ``text``, where keys repeat, no pair of rows is formed.

    ``dims`` are all dimensions that the predictions have, unless given.
    """
    dims = list(dims or [d for d in DIMENSIONS if f"{d}_pred" in preds.columns] or DIMENSIONS)
    if how == "auto":
        how = choose_key(preds, gold) or "position"
    if how == "text":
        if rescale:
            preds = auto_unscale(preds, [f"{d}_pred" for d in dims])
        return evaluate_pairs(preds, gold, "text", dims)
    aligned = align(preds, gold, how, order_preds, order_gold)
    return evaluate(aligned, dims, order="id" if how == "id" else "pos", auto_unscale=rescale)


def compare_reports(single: DataFrame, joint: DataFrame, files: dict[str, str]) -> DataFrame:
    """Side-by-side table of one report per dimension (``a``) and one report with all sections (``b``).

    Both are ``(run, value)`` tables; ``files`` names the single report of each
    dimension. A missing or unreadable report leaves NULLs.
    """
    by_file = F.create_map(*[F.lit(x) for dim, name in files.items() for x in (name, dim)])
    a = parse_single(report_lines(single), keep="last").withColumn("dim", F.try_element_at(by_file, F.col("run")))
    b = last_sections(parse_sections(report_lines(joint)))
    return compare_runs(a, b)
