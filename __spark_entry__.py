"""

All queries read the whole of their tables. ``documents`` with ``labels`` serves as
the annotated table (documents without labels have no targets), and every document
has a prediction. Run names are languages or event types.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracles import ORACLES
from tonescale import sources
from tonescale.functions import DIMENSIONS, to_number, tokens, unscale_prediction
from tonescale.operators import align, clean, encode, features, fit, metrics, monitor, position, profile, report, split, wide
from tonescale.operators.score import LinearWeights, as_weights, score_features
from tonescale.plans import jobs, stages
from tonescale.session import broadcast_if_small, scratch_path

try:
    from tonescale.llm import queries as llm_queries
    from tonescale.llm import sql as llm_sql
except ImportError:  # the package and its pipeline can be left out
    llm_queries = llm_sql = None
try:
    import corpus_pipeline
except ImportError:
    corpus_pipeline = None

SAMPLE = "/root/testdata/sf0.001"
PREDICTED = [f"{d}_pred" for d in DIMENSIONS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: V from the labels, A from the text length, D unrelated to the text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # Small labels come to the texts.
    both = docs.join(broadcast_if_small(labels).withColumn("labelled", F.lit(True)), "doc_id", "left")
    one, two, four = F.lit(1.0), F.lit(2.0), F.lit(4.0)
    length = F.col("n_chars").cast("double") / (F.col("n_chars").cast("double") + F.lit(2000.0))
    return both.select(
        F.col("doc_id").alias("id"),
        "text",
        "lang",
        F.when(F.col("labelled"), one + two * F.col("quality") + two * (1 - F.col("toxic"))).alias("V"),
        F.when(F.col("labelled"), one + four * length).alias("A"),
        F.when(F.col("labelled"), one + four * (F.col("doc_id") % 97) / F.lit(96.0)).alias("D"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_annotated(annotated(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for every document; D is constant."""
    three = F.lit(3.0)
    return annotated(spark, sf_dir).select(
        "id",
        "text",
        "lang",
        (F.coalesce("V", three) + ((F.col("id") * 31) % 11 - 5) * F.lit(0.0731)).alias("V_pred"),
        (F.coalesce("A", three) + ((F.col("id") * 17) % 13 - 6) * F.lit(0.0517)).alias("A_pred"),
        three.alias("D_pred"),
    )


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event type and one epoch per day: its mean value is the loss."""
    daily = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("day"))
        .agg(F.avg("value").alias("loss"))
    )
    # One row per day and run is left here.
    days = Window.partitionBy("run").orderBy("day")
    return daily.select("run", F.row_number().over(days).alias("epoch"), "loss")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _ids(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as text."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in columns})


# --- evaluation -----------------------------------------------------------------------------------------------------


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(predictions(spark, sf_dir).drop("text", "lang"), annotated(spark, sf_dir).drop("text"), "id")


def evaluate_by_dim(spark, sf_dir):
    return rounded(metrics.evaluate(_aligned(spark, sf_dir)), "mae", "pearson_r")


def evaluate_by_run(spark, sf_dir):
    return rounded(metrics.evaluate(_aligned(spark, sf_dir), by=["lang"]), "mae", "pearson_r")


def evaluate_text_pairs(spark, sf_dir):
    found = metrics.evaluate_pairs(predictions(spark, sf_dir), annotated(spark, sf_dir), "text")
    return rounded(found, "mae", "pearson_r")


def evaluate_auto_unscale(spark, sf_dir):
    preds = predictions(spark, sf_dir).select("id", *[(F.col(c) / F.lit(7.0)).alias(c) for c in PREDICTED])
    aligned = align.align(preds, annotated(spark, sf_dir).drop("text", "lang"), "id")
    return rounded(metrics.evaluate(aligned, auto_unscale=True), "mae", "pearson_r")


def auto_unscale(spark, sf_dir):
    """V lies on the 0-1 scale, A and D do not."""
    preds = predictions(spark, sf_dir).select("id", (F.col("V_pred") / F.lit(7.0)).alias("V_pred"), "A_pred", "D_pred")
    return rounded(clean.auto_unscale(preds, PREDICTED), *PREDICTED)


def pearson_plain(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    y, p = F.col("l_extendedprice"), F.col("l_quantity")
    found = lines.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), metrics.mae(y, p).alias("mae"), metrics.pearson(y, p).alias("pearson_r")
    )
    return found.select("l_returnflag", "n", F.round("mae", 4).alias("mae"), F.round("pearson_r", 6).alias("pearson_r"))


def pearson_constant(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    flat = F.lit(3.0) * F.col("l_quantity") / F.col("l_quantity")
    found = lines.groupBy("l_returnflag").agg(
        metrics.guarded_pearson(F.col("l_tax"), flat).alias("r_flat"),
        metrics.pearson(F.col("l_tax"), flat).alias("r_null"),
        metrics.guarded_pearson(F.col("l_tax"), F.col("l_discount")).alias("r_both"),
    )
    return rounded(found, "r_flat", "r_null", "r_both")


# --- cleaning and projection ----------------------------------------------------------------------------------------


def drop_missing_any(spark, sf_dir):
    return rounded(clean.clean_annotated(annotated(spark, sf_dir)).select("id", *DIMENSIONS), *DIMENSIONS)


def drop_missing_all(spark, sf_dir):
    """Documents with none of: a label, a vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"))
    both = annotated(spark, sf_dir).select("id", "V").join(vectors, "id", "left")
    return clean.drop_missing(both, ["V", "label"], "all")


def select_target(spark, sf_dir):
    target = clean.select_target(annotated(spark, sf_dir), "A")
    kept = clean.cast_targets(clean.drop_missing(target, ["text", "A"]), ["A"])
    return kept.select("id", F.md5("text").alias("text_md5"), F.round("A", 6).alias("A"))


def scale_roundtrip(spark, sf_dir):
    scaled = clean.scale_targets(gold(spark, sf_dir), suffix="_01")
    back = clean.unscale_predictions(scaled, [f"{d}_01" for d in DIMENSIONS], suffix="_back")
    made = [f"{d}_01{s}" for d in DIMENSIONS for s in ("", "_back")]
    return rounded(back.select("id", *made), *made)


def lenient_numbers(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") > 40, F.col("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string")))
    return part.select("p_partkey", F.round(to_number(text), 4).alias("number"))


def head_rows(spark, sf_dir):
    return clean.head_rows(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


def table_profile(spark, sf_dir):
    names = ["documents", "labels", "pages", "conversations", "benchmark"]
    rows = [profile.profile_table(table(spark, sf_dir, n), n) for n in names]
    found = rows[0]
    for row in rows[1:]:
        found = found.unionByName(row)
    return found


# --- splits ---------------------------------------------------------------------------------------------------------


def split_round(spark, sf_dir):
    return split.split_exact(gold(spark, sf_dir), rule="round").select("id", "split")


def split_ceil(spark, sf_dir):
    return jobs.prepare_joint(annotated(spark, sf_dir)).select("id", "split")


def split_sizes(spark, sf_dir):
    """Both size rules, on all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    sizes = [
        split.split_sizes(split.split_exact(docs, rule=rule)).withColumn("rule", F.lit(rule)) for rule in split.RULES
    ]
    return sizes[0].unionByName(sizes[1])


def split_complement(spark, sf_dir):
    """Documents outside the labelled set."""
    rest = split.complement(annotated(spark, sf_dir), gold(spark, sf_dir))
    return rest.select("id", "lang")


def targets_long(spark, sf_dir):
    """Separate-fit tables, with the unlabelled texts of ``benchmark`` as held-out set."""
    test = table(spark, sf_dir, "benchmark").select(
        (-1 - F.col("item_id")).alias("id"), "text", F.lit(1.0).alias("V"), F.lit(3.0).alias("A"), F.lit(5.0).alias("D")
    )
    long = jobs.prepare_single(annotated(spark, sf_dir), test)
    return long.select("id", F.md5("text").alias("text_md5"), "split", "dim", F.round("value", 6).alias("value"))


# --- alignment ------------------------------------------------------------------------------------------------------


def align_id(spark, sf_dir):
    paired = jobs.align(predictions(spark, sf_dir).drop("lang"), gold(spark, sf_dir).drop("lang"))
    names = [*PREDICTED, *DIMENSIONS]
    return rounded(paired.select("id", F.md5("text_gold").alias("text_md5"), *names), *names)


def align_text(spark, sf_dir):
    """Pairs on repeated texts; equal pairs are counted in ``n_rows``."""
    names = [*PREDICTED, *DIMENSIONS]
    preds, known = rounded(predictions(spark, sf_dir), *PREDICTED), rounded(gold(spark, sf_dir), *DIMENSIONS)
    paired = align.align_counted(preds, known)
    return paired.select(F.md5("text").alias("text_md5"), *names, "n_rows")


def align_position(spark, sf_dir):
    """Predictions in id order meet gold rows in descending id order."""
    preds = align.align(predictions(spark, sf_dir), gold(spark, sf_dir).select("id"), "id").select("V_pred", F.col("id").alias("p"))
    known = gold(spark, sf_dir).select("V", F.col("id").alias("g"))
    paired = align.align(preds, known, "position", ["p"], [F.desc("g")])
    return rounded(paired.select("pos", "p", "g", "V", "V_pred"), "V", "V_pred")


def align_prefix(spark, sf_dir):
    """Fewer predictions than gold rows: one per labelled document, against all documents."""
    preds = gold(spark, sf_dir).select((F.col("A") + F.lit(0.25)).alias("A_pred"), F.col("id").alias("p"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("g"), "n_chars")
    return rounded(align.align(preds, docs, "prefix", ["p"], ["g"]), "A_pred")


def align_coverage(spark, sf_dir):
    preds, known = predictions(spark, sf_dir), gold(spark, sf_dir)
    rows = [align.coverage(preds, known, key).withColumn("key", F.lit(key)) for key in ("id", "text")]
    return rows[0].unionByName(rows[1])


# --- losses and early stopping --------------------------------------------------------------------------------------


def _loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = align.align(predictions(spark, sf_dir).drop("text", "lang"), gold(spark, sf_dir).drop("text", "lang"), "id")
    return paired.select("id", *PREDICTED, *DIMENSIONS)


def smooth_l1_batches(spark, sf_dir):
    """One target, batches of 16 in id order."""
    rows = position.with_position(_loss_rows(spark, sf_dir).select("id", "V", "V_pred"), ["id"])
    rows = rows.withColumn("batch_id", position.batch_of("pos"))
    return rounded(metrics.batch_losses(rows, [("V", "V_pred")]), "batch_loss")


def epoch_loss(spark, sf_dir):
    """Three targets together, on the 0-1 scale; a short last batch counts in full."""
    rows = position.with_position(_loss_rows(spark, sf_dir), ["id"]).withColumn("batch_id", position.batch_of("pos"))
    rows = clean.scale_targets(rows, [*DIMENSIONS, *PREDICTED])
    batches = metrics.batch_losses(rows, list(zip(DIMENSIONS, PREDICTED, strict=True)))
    return rounded(metrics.epoch_loss(batches), "loss", digits=8)


def smooth_l1_lines(spark, sf_dir):
    """Both branches of the loss over all of ``lineitem``."""
    lines = table(spark, sf_dir, "lineitem").withColumns(
        {"y": F.col("l_discount") * F.lit(20.0), "p": F.col("l_tax") * F.lit(20.0)}
    )
    found = metrics.batch_losses(lines, [("y", "p")], batch="l_linenumber", by=["l_returnflag"])
    return rounded(found, "batch_loss")


def shuffle_batches(spark, sf_dir):
    """Random order of all documents in epoch 3, in batches of 16."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    placed = position.shuffled_position(docs, "id", seed=42, epoch=3)
    return placed.withColumn("batch_id", position.batch_of("pos"))


def early_stopping(spark, sf_dir):
    return rounded(monitor.early_stopping(loss_log(spark, sf_dir)), "best_loss")


def best_epoch(spark, sf_dir):
    kept = monitor.early_stopping(loss_log(spark, sf_dir), patience=5, max_epochs=20)
    return rounded(kept.select("run", "best_epoch", "best_loss"), "best_loss")


# --- encoding -------------------------------------------------------------------------------------------------------


def vocab(spark, sf_dir):
    return encode.build_vocab(table(spark, sf_dir, "documents"))


def _encoded(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode.encode_sequences(docs, encode.build_vocab(docs), key="doc_id", **settings)


def encode_sequences(spark, sf_dir):
    return _ids(_encoded(spark, sf_dir, max_len=64).select("doc_id", "input_ids"), "input_ids")


def encode_sequences_joined(spark, sf_dir):
    """Without start and end marks, longer."""
    found = _encoded(spark, sf_dir, max_len=128, special=False)
    return _ids(found.select("doc_id", "input_ids"), "input_ids")


def encode_unknown(spark, sf_dir):
    """The vocabulary of the texts in other languages: unknown tokens. Languages as keys repeat, and every 13th key and text is NULL."""
    docs = table(spark, sf_dir, "documents")
    odd = F.col("doc_id") % 13
    rows = docs.select(F.when(odd != 5, F.col("lang")).alias("lang"), F.when(odd != 7, F.col("text")).alias("text"))
    found = encode.encode_sequences(rows, encode.build_vocab(docs.filter("lang <> 'en'")), max_len=32, key="lang")
    return _ids(found.select("lang", "input_ids"), "input_ids").groupBy("lang", "input_ids").agg(F.count("*").alias("n"))


def attention_mask(spark, sf_dir):
    return _ids(_encoded(spark, sf_dir, max_len=64).select("doc_id", "attention_mask"), "attention_mask")


# --- fitting and scoring --------------------------------------------------------------------------------------------

WIDTH = 64  # of the stored vectors


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors with targets that are linear in them."""
    x = F.col("embedding").cast("array<double>")
    e = [F.get(x, F.lit(i)) for i in range(3)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        x.alias("features"),
        (F.lit(3.0) + e[0] * F.lit(1.7071) - e[1]).alias("V"),
        (F.lit(2.5) + e[2] * F.lit(0.9137)).alias("A"),
        (F.lit(3.5) - e[0] * F.lit(1.3193) + e[2] * F.lit(0.4811)).alias("D"),
    )


def score_fixed_weights(spark, sf_dir):
    steps = np.arange(WIDTH)
    weights = np.array([(steps % (5 + k) - 2) / 10.0 for k in range(3)])
    model = LinearWeights(DIMENSIONS, weights, np.array([0.6, 0.5, 0.4]))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    return rounded(score_features(vectors, model).select("vec_id", *PREDICTED), *PREDICTED)


def gram_sums(spark, sf_dir):
    """Products of all components and the label."""
    x = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select(x.alias("features"), F.col("label").cast("double").alias("y"))
    return rounded(fit.cross_products(rows, WIDTH, ["y"]), "value")


def fit_single_scalar(spark, sf_dir):
    """Length of the text as the only feature, one fit per dimension."""
    rows = gold(spark, sf_dir).withColumn("features", F.array(F.length("text").cast("double") / F.lit(1000.0)))
    fitted = [(d, fit.fit_single(rows, d, reg=0.0)) for d in DIMENSIONS]
    found = [(d, float(m.coefficients[0]), float(m.intercept)) for d, m in fitted]
    return rounded(spark.createDataFrame(found, "dim string, slope double, intercept double"), "slope", "intercept")


def fit_multi_exact(spark, sf_dir):
    """Targets linear in the vectors are recovered by the joint fit without penalty."""
    rows = _vectors(spark, sf_dir)
    scored = score_features(rows, fit.fit_multi(rows, WIDTH, reg=0.0))
    return rounded(scored.select("id", *PREDICTED), *PREDICTED, digits=4)


def stored_vectors(spark, sf_dir):
    """The vectors joined by key as features, fitted and scored."""
    encoder = features.StoredVectors(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"))
    rows = encoder.transform(_vectors(spark, sf_dir).drop("features"))
    scored = score_features(rows, fit.fit_multi(rows, WIDTH, reg=0.0))
    return rounded(scored.select("id", *PREDICTED), *PREDICTED, digits=4)


def fit_single_exact(spark, sf_dir):
    """The same targets recovered by one Spark ML fit per dimension."""
    rows = _vectors(spark, sf_dir)
    model = as_weights([(d, fit.fit_single(rows, d, reg=0.0)) for d in DIMENSIONS])
    return rounded(score_features(rows, model).select("id", *PREDICTED), *PREDICTED, digits=4)


class TextLength:
    """One feature: the length of the text in thousands of characters."""

    size = 1

    def transform(self, df: DataFrame) -> DataFrame:
        length = F.length("text").cast("double") / F.lit(1000.0)
        return df.withColumn("features", F.when(F.col("text").isNotNull(), F.array(length)))


def single_chain(spark, sf_dir):
    """The separate-fit jobs from preparation to metrics, for two of the targets; every 13th text to score is missing."""
    known = gold(spark, sf_dir)
    parts = jobs.prepare_single(known)
    model = jobs.train_single(parts, TextLength(), dims=["V", "A"], reg=0.0)
    val = parts.filter("split = 'val' AND dim = 'V'").select("id", F.when(F.col("id") % 13 != 7, F.col("text")).alias("text"))
    scored = jobs.predict(val, model).drop("text")
    return rounded(jobs.evaluate_run(scored, known.drop("text")), "mae", "pearson_r")


def fit_multi_metrics(spark, sf_dir):
    """Clean, split, encode, fit jointly, score the validation rows and evaluate them."""
    parts = jobs.prepare_joint(annotated(spark, sf_dir))
    model = jobs.train_joint(parts, size=64, reg=0.02)
    scored = jobs.predict(parts.filter(F.col("split") == "val"), model)
    return rounded(metrics.evaluate(scored), "mae", "pearson_r")


def _only(texts: DataFrame, *words: str) -> DataFrame:
    """The texts without all other words."""
    kept = F.filter(tokens("text"), lambda w: w.isin(*words))
    return texts.withColumn("text", F.array_join(kept, " "))


def scaled_terms(spark, sf_dir):
    """Hashed counts of three words, centred and divided by their standard deviations."""
    docs = _only(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "the", "of", "de")
    found = features.fit_weighting(docs, features.HashedTerms(256), scale=True, center=True).transform(docs)
    x = F.col("features")
    zero = F.lit(0.0)
    sums = [F.aggregate(x, zero, lambda a, v: a + v).alias("total"), F.aggregate(x, zero, lambda a, v: a + v * v).alias("square"), F.array_max(x).alias("top")]
    return rounded(found.select("id", *sums), "total", "square", "top")


def fit_idf_terms(spark, sf_dir):
    """Hashed counts of three words weighted by document frequencies, fitted on the training rows; every document is scored."""
    parts = jobs.prepare_joint(_only(annotated(spark, sf_dir), "the", "of", "de"))
    encoder = features.fit_weighting(parts.filter("split = 'train'"), features.SparseTerms(4096))
    model = jobs.train_joint(parts, encoder=encoder, reg=0.02, solver="gradients")
    docs = _only(annotated(spark, sf_dir).select("id", "text"), "the", "of", "de")
    return rounded(jobs.predict(docs, model).drop("text"), *PREDICTED)


def fit_wide_groups(spark, sf_dir):
    """A weight for every ten documents, fitted by conjugate gradients to three figures of them; every document is scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n"))
    group = F.floor(F.col("doc_id") / 10).cast("int")
    size = docs.agg(F.max(group)).first()[0] + 1
    one = F.struct(F.array(group).alias("indices"), F.array(F.lit(1.0)).alias("values")).alias("features")
    targets = [F.lit(5.0) * F.col("n") / (F.col("n") + 2000), F.col("n") % 7, F.col("doc_id") % 97 / 20]
    model = wide.fit_wide(docs.select(one, *[t.cast("double").alias(d) for t, d in zip(targets, DIMENSIONS)]), size, reg=0.0001)
    return rounded(score_features(docs.select("doc_id", one), model).drop("features"), *PREDICTED)


def epochs_joint(spark, sf_dir):
    """One feature, one target, full batches: the log of the losses."""
    parts = jobs.prepare_joint(annotated(spark, sf_dir))
    fitted = jobs.train_epochs(parts, size=1, encoder=TextLength(), dims=["V"], epochs=3, batches_per_epoch=1, rate=0.01)
    return rounded(fitted.losses, "train_loss", "val_loss", digits=8)


def epochs_separate(spark, sf_dir):
    """Two targets that stop on their own, fitted in the same passes."""
    parts = jobs.prepare_joint(annotated(spark, sf_dir))
    fitted = jobs.train_epochs(
        parts, size=1, encoder=TextLength(), dims=["V", "A"], epochs=3, batches_per_epoch=1, rate=0.01, joint=False
    )
    return rounded(fitted.losses, "train_loss", "val_loss", digits=8)


def epochs_minibatch(spark, sf_dir):
    """A step for every 16 rows by three workers, averaged after each epoch: the log of the losses."""
    parts = jobs.prepare_joint(annotated(spark, sf_dir))
    fitted = jobs.train_minibatches(parts, size=1, encoder=TextLength(), dims=["V"], epochs=3, rate=0.003, workers=3)
    return rounded(fitted.losses, "train_loss", "val_loss", digits=8)


def minibatch_scores(spark, sf_dir):
    """Every document scored by the best epoch of the mini-batch fit."""
    rows = annotated(spark, sf_dir)
    fitted = jobs.train_minibatches(jobs.prepare_joint(rows), size=1, encoder=TextLength(), dims=["V"], epochs=3, rate=0.003, workers=3)
    return rounded(jobs.predict(rows.select("id", "text"), fitted.model).drop("text"), "V_pred")


def fit_epochs_losses(spark, sf_dir):
    parts = jobs.prepare_joint(annotated(spark, sf_dir))
    fitted = jobs.train_epochs(parts, size=64, epochs=4, batches_per_epoch=2, rate=3e-3)
    return rounded(fitted.losses, "train_loss", "val_loss", digits=8)


def score_table(spark, sf_dir):
    """Every document scored by a separate fit per dimension; rows keep their columns."""
    parts = split.split_exact(gold(spark, sf_dir), rule="round")
    model = jobs.train_single(parts, features.HashedTerms(64), reg=0.02)
    scored = jobs.predict(table(spark, sf_dir, "documents"), model)
    return rounded(scored.select("doc_id", "lang", "n_chars", *PREDICTED), *PREDICTED)


# --- reports --------------------------------------------------------------------------------------------------------


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per language."""
    found = metrics.evaluate(_aligned(spark, sf_dir), by=["lang"])
    return report.render_report(found.withColumnRenamed("lang", "run"))


def report_render(spark, sf_dir):
    return _reports(spark, sf_dir)


def report_parse(spark, sf_dir):
    parsed = report.parse_sections(report.report_lines(_reports(spark, sf_dir)))
    return report.table_sections(parsed)


def section_carry(spark, sf_dir):
    """Every line, the title and blank ones too."""
    lines = report.carry_section(report.report_lines(_reports(spark, sf_dir)))
    return lines.select("run", "line_no", "dim", "section_no")


def report_single(spark, sf_dir):
    """First and last metric of each report, read as reports on a single dimension."""
    lines = report.report_lines(_reports(spark, sf_dir))
    kept = [report.parse_single(lines, keep=k).withColumn("dim", F.lit(d)) for k, d in (("first", "V"), ("last", "D"))]
    tables = [report.table_single(k, by=["run"]) for k in kept]
    return tables[0].unionByName(tables[1])


def _two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run a as predicted; run b from plain means, without dimension D."""
    aligned = _aligned(spark, sf_dir)
    a = metrics.evaluate(aligned, by=["lang"])
    b = metrics.evaluate(aligned.withColumns({"V_pred": F.lit(3.0), "A_pred": F.col("V_pred")}), ["V", "A"], by=["lang"])
    return rounded(report.compare_runs(a, b, by=["lang"]), "mae_a", "pearson_r_a", "mae_b", "pearson_r_b")


def compare_runs(spark, sf_dir):
    return _two_runs(spark, sf_dir)


def chart_long(spark, sf_dir):
    return report.chart_long(_two_runs(spark, sf_dir), by=["lang"])


def any_present(spark, sf_dir):
    nothing = F.when(F.col("lang") == "no such language", F.lit(1.0))
    return metrics.any_present(annotated(spark, sf_dir).withColumn("nothing", nothing), ["V", "A", "nothing"])


def learning_curve(spark, sf_dir):
    """Daily means as training losses; the validation log covers the early-stopped epochs only."""
    train = loss_log(spark, sf_dir)
    stops = monitor.early_stopping(train).select("run", "epochs_run")
    val = train.join(stops, "run").filter(F.col("epoch") <= F.col("epochs_run"))
    val = val.select("run", "epoch", (F.col("loss") * F.lit(1.1)).alias("loss"))
    return rounded(report.learning_curve(train, val), "train_loss", "val_loss")


def row_counts(spark, sf_dir):
    sides = {"preds": predictions(spark, sf_dir), "gold": gold(spark, sf_dir)}
    rows = [df.agg(F.count("*").alias("n")).withColumn("input", F.lit(n)) for n, df in sides.items()]
    return rows[0].unionByName(rows[1])


# --- files ----------------------------------------------------------------------------------------------------------


def csv_round_trip(spark, sf_dir):
    """Every document, with its quotes and line breaks, written as CSV and read back."""
    path = scratch_path(spark, "csv")
    sources.write_csv(annotated(spark, sf_dir).drop("lang"), path)
    df = sources.read_annotated(spark, path)
    return rounded(df.select(F.col("id").cast("long").alias("id"), F.md5("text").alias("text_md5"), *DIMENSIONS), *DIMENSIONS)


def folder_profile(spark, sf_dir):
    """Per-target CSV files of all labelled documents, and one of 81 columns, profiled as one folder."""
    path = scratch_path(spark, "folder")
    known = gold(spark, sf_dir)
    sources.write_csv(known.select("text", F.col("V").alias("target")), path)
    sources.write_csv(known.select("text", F.col("lang").alias("target"), "A"), path, mode="append")
    wide = known.select("text", *[(F.col("V") + F.lit(i)).alias(f"f{i}") for i in range(80)])
    sources.write_csv(wide, path, mode="append")
    files = profile.profile_folder(spark, path)
    # How many files there are, some perhaps with a header only, depends on the partitions.
    return files.groupBy("columns", "n_columns", "has_text", "two_columns", "target").agg(
        F.bool_or("target_numeric").alias("target_numeric"),
        F.sum("n_rows").alias("n_rows"),
        F.count("error").alias("errors"),
    )


def csv_folder(spark, sf_dir):
    """Files with their columns in different orders, some without a column, read as one folder."""
    path = scratch_path(spark, "layouts")
    known = gold(spark, sf_dir)
    one, two = known.filter("id % 2 = 0"), known.filter("id % 2 = 1")
    sources.write_csv(one.select("id", "text", "V", "A", "D"), path)
    sources.write_csv(two.select("D", "text", "lang", "V", "A", "id"), path, mode="append")
    found = sources.read_annotated(spark, path)
    return rounded(found.select("id", F.md5("text").alias("text_md5"), "lang", *DIMENSIONS), *DIMENSIONS)


def prepare_without_id(spark, sf_dir):
    """A table without ids is imported and split: sizes of its parts and sums of its targets."""
    path = scratch_path(spark, "unnamed")
    sources.write_csv(gold(spark, sf_dir).select("text", *DIMENSIONS), f"{path}/csv")
    dev = sources.import_annotated(spark, f"{path}/csv", f"{path}/parquet")
    parts = jobs.prepare_joint(dev)
    return parts.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.count_distinct("id").alias("ids"),
        *[F.round(F.sum(d), 6).alias(d) for d in DIMENSIONS],
    )


def texts_round_trip(spark, sf_dir):
    """Unlabelled texts written as CSV and read back with their ids; missing texts stay missing."""
    path = scratch_path(spark, "texts")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 != 7, F.col("text")).alias("text"), "lang"
    )
    sources.write_csv(docs, path)
    return sources.read_texts(spark, path).select("id", F.md5("text").alias("text_md5"))


def split_files(spark, sf_dir):
    """The per-dimension split tables, read back folder by folder."""
    path = scratch_path(spark, "splits")
    sources.write_splits(jobs.prepare_single(gold(spark, sf_dir)), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("dim", "split").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def prediction_files(spark, sf_dir):
    """Predictions of two evaluation sets of one run, one as parquet and one as CSV, read back."""
    path, preds = scratch_path(spark, "predictions"), rounded(predictions(spark, sf_dir), *PREDICTED)
    first = sources.write_predictions(preds.filter("lang = 'en'").drop("text"), path, "r1", "english")
    second = sources.write_predictions(preds.filter("lang <> 'en'").select("id", "text", *PREDICTED), path, "r1", "other", fmt="csv")
    numbers = ["id", *PREDICTED]
    csv = sources.read_annotated(spark, second, PREDICTED)
    both = spark.read.parquet(first).select(*numbers, F.lit("english").alias("eval_set")).unionByName(csv.select(*numbers, F.lit("other").alias("eval_set")))
    return rounded(both, *PREDICTED)


def appended_losses(spark, sf_dir):
    """A loss table whose runs are replaced one by one."""
    path, log = scratch_path(spark, "appended"), loss_log(spark, sf_dir)
    sources.append_losses(log.withColumn("loss", F.lit(-1.0)), path)
    sources.append_losses(log, path)
    stored = spark.read.parquet(path)
    return rounded(stored.select("run", "epoch", "loss"), "loss")


def evaluate_text_id(spark, sf_dir):
    """Ids as text, as a CSV file may have them."""
    text_id = F.concat(F.lit("d"), F.col("id"))
    preds = predictions(spark, sf_dir).drop("text", "lang").withColumn("id", text_id)
    aligned = align.align(preds, annotated(spark, sf_dir).drop("text", "lang").withColumn("id", text_id), "id")
    return rounded(metrics.evaluate(aligned), "mae", "pearson_r")


def report_missing(spark, sf_dir):
    """Reports with a correlation that is undefined (dimension D), written and read back."""
    path = scratch_path(spark, "reports")
    found = metrics.evaluate(_aligned(spark, sf_dir), by=["lang"], on_constant="null")
    sources.write_reports(report.render_report(found.withColumnRenamed("lang", "run")), path)
    parsed = report.parse_sections(report.report_lines(sources.read_reports(spark, path)))
    missing = F.isnan("pearson_r")
    return parsed.select("run", "dim", "mae", missing.alias("missing"), F.when(~missing, F.col("pearson_r")).alias("pearson_r"))


def report_files(spark, sf_dir):
    path = scratch_path(spark, "reports")
    sources.write_reports(_reports(spark, sf_dir), path)
    parsed = report.parse_sections(report.report_lines(sources.read_reports(spark, path)))
    return report.table_sections(parsed)


def loss_log_files(spark, sf_dir):
    path = scratch_path(spark, "losses")
    # With more decimals no loss lies half way between two logged values.
    sources.write_loss_log(loss_log(spark, sf_dir).withColumn("loss", F.col("loss") * F.lit(0.37731)), path)
    return sources.read_loss_log(spark, path).select("run", "epoch", F.round("loss", 4).alias("loss"))


def stored_model(spark, sf_dir):
    """The joint fit, stored and loaded before it scores."""
    path, rows = scratch_path(spark, "model"), _vectors(spark, sf_dir)
    fit.fit_multi(rows, WIDTH, reg=0.0).save(spark, path)
    scored = score_features(rows, LinearWeights.load(spark, path))
    return rounded(scored.select("id", *PREDICTED), *PREDICTED, digits=4)


def stored_pipeline(spark, sf_dir):
    """Stored vectors and the joint fit as stages of one Spark ML pipeline, stored with the vectors and loaded before it scores."""
    path, rows = scratch_path(spark, "pipeline"), _vectors(spark, sf_dir).drop("features")
    encoder = features.StoredVectors(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"))
    fitted = Pipeline(stages=[stages.EncoderStage(encoder), stages.DimensionRegressor(WIDTH, reg=0.0)]).fit(rows)
    fitted.write().overwrite().save(path)
    scored = PipelineModel.load(path).transform(rows)
    return rounded(scored.select("id", *PREDICTED), *PREDICTED, digits=4)


def stored_encoder(spark, sf_dir):
    """A supplied batch encoder, stored within its pipeline: every document is scored by what was loaded, missing texts too."""

    def make():
        return lambda texts: np.array([[len(t) / 1000.0] for t in texts])

    path = scratch_path(spark, "pipeline")
    fitted = Pipeline(stages=[stages.EncoderStage(features.BatchEncoder(make, batch_size=256)), stages.DimensionRegressor(1, ["V", "A"], reg=0.0)])
    fitted.fit(gold(spark, sf_dir)).write().overwrite().save(path)
    docs = annotated(spark, sf_dir).select("id", F.when(F.col("id") % 13 != 7, F.col("text")).alias("text"))
    scored = PipelineModel.load(path).transform(docs)
    return rounded(scored.select("id", "V_pred", "A_pred"), "V_pred", "A_pred")


def align_spread(spark, sf_dir):
    """Every document meets the figures of its language: a few keys that have all rows, and the missing one (every 13th)."""
    docs = annotated(spark, sf_dir).withColumn("lang", F.when(F.col("id") % 13 != 7, F.col("lang")))
    preds = docs.select(F.col("lang").alias("id"), F.col("id").alias("doc_id"), (F.length("text") / F.lit(1000.0)).alias("A_pred"))
    known = docs.groupBy(F.col("lang").alias("id")).agg(F.count("*").alias("n"), F.avg(F.length("text") / F.lit(1000.0)).alias("A"))
    return rounded(align.align_spread(preds, known, "id", most=500), "A_pred", "A")


def align_bucketed(spark, sf_dir):
    """Predictions and gold stored in buckets by id and joined where they lie."""
    path, name = scratch_path(spark, "buckets"), f"buckets_{uuid.uuid4().hex}"
    preds = sources.store_bucketed(predictions(spark, sf_dir).drop("text", "lang"), f"{name}_p", f"{path}/p", buckets=8)
    known = sources.store_bucketed(annotated(spark, sf_dir).drop("text", "lang"), f"{name}_g", f"{path}/g", buckets=8)
    return rounded(align.align(preds, known, "id", missing="drop"), *PREDICTED, *DIMENSIONS)


def split_files_counted(spark, sf_dir):
    """The split tables as they were stored, each row with the size of its table, counted while it was written."""
    path = scratch_path(spark, "splits")
    known = gold(spark, sf_dir).select("id", F.md5("text").alias("text"), *DIMENSIONS)
    sizes = sources.write_splits_counted(jobs.prepare_single(known), path)
    counted = spark.createDataFrame(sizes, "dim string, split string, n long")
    return rounded(spark.read.parquet(path).join(F.broadcast(counted), ["dim", "split"]).select("id", "dim", "split", "value", "n"), "value")


def aligned_files_counted(spark, sf_dir):
    """Aligned rows as they were stored, with the counts of the job that stored them."""
    path = scratch_path(spark, "aligned")
    preds = predictions(spark, sf_dir).filter("id % 7 <> 0").select("id", *PREDICTED)
    found = sources.write_aligned(preds, gold(spark, sf_dir).select("id", *DIMENSIONS), path)
    counts = [F.lit(n).cast("long").alias(c) for c, n in found.items()]
    return rounded(spark.read.parquet(path).select("id", *PREDICTED, *DIMENSIONS, *counts), *PREDICTED, *DIMENSIONS)


def appended_epochs(spark, sf_dir):
    """A log that grows: all epochs of some runs, then single epochs of one of them again; the others stay."""
    path, log = scratch_path(spark, "epochs"), loss_log(spark, sf_dir)
    by = ("run", "epoch")
    sources.append_losses(log.filter("epoch <= 20"), path, by)
    sources.append_losses(log.filter("epoch > 20 AND run <> 'view'"), path, by)
    sources.append_losses(log.filter("epoch IN (3, 20, 21) AND run = 'click'").withColumn("loss", -F.col("loss")), path, by)
    return rounded(spark.read.parquet(path).select("run", F.col("epoch").cast("int").alias("epoch"), "loss"), "loss")


def refused_tables(spark, sf_dir):
    """Parts of the documents to score: a part without a row is refused, the others keep all their rows."""
    model = LinearWeights(("V",), np.zeros((1, 1)), np.array([0.4]))
    parts = {"all": F.lit(True), "labelled": F.col("V").isNotNull(), "unknown language": F.col("lang") == "xx"}
    rows = annotated(spark, sf_dir).select("id", "lang", "text", "V")
    scored = spark.createDataFrame([], "part string, id long, V_pred double, refused boolean")
    for name, part in parts.items():
        try:
            found = jobs.predict(rows.filter(part).drop("V"), model, TextLength()).select(F.lit(name).alias("part"), "id", "V_pred", F.lit(False).alias("refused"))
        except ValueError:
            found = spark.createDataFrame([(name, -1, None, True)], scored.schema)
        scored = scored.unionByName(found)
    return rounded(scored, "V_pred")


def position_ties(spark, sf_dir):
    """Documents numbered by language alone: each language has a run of positions, whatever its rows."""
    return position.with_position(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"]).select("pos", "lang")


QUERIES = (
    evaluate_by_dim, evaluate_by_run, evaluate_text_pairs, evaluate_auto_unscale, auto_unscale, pearson_plain,
    pearson_constant, drop_missing_any, drop_missing_all, select_target, scale_roundtrip, lenient_numbers, head_rows,
    table_profile, split_round, split_ceil, split_sizes, split_complement, targets_long, align_id, align_text,
    align_position, align_prefix, align_coverage, smooth_l1_batches, epoch_loss, smooth_l1_lines, shuffle_batches,
    early_stopping, best_epoch, vocab, encode_sequences, encode_sequences_joined, encode_unknown, attention_mask, score_fixed_weights,
    gram_sums, fit_single_scalar, fit_multi_exact, stored_vectors, fit_single_exact, single_chain, fit_multi_metrics, epochs_joint, epochs_separate, epochs_minibatch, minibatch_scores,
    scaled_terms, fit_idf_terms, fit_wide_groups,
    fit_epochs_losses, score_table,
    report_render, report_parse, section_carry, report_single, compare_runs, chart_long, any_present, learning_curve,
    row_counts, csv_round_trip, csv_folder, prepare_without_id, texts_round_trip, split_files, prediction_files,
    appended_losses, evaluate_text_id, folder_profile, report_missing, report_files, loss_log_files, stored_model,
    stored_pipeline, stored_encoder, align_spread, align_bucketed, split_files_counted, aligned_files_counted, appended_epochs, refused_tables, position_ties,
)


def entry(spark: SparkSession) -> DataFrame:
    """Clean, split, encode, fit, score and evaluate in one job."""
    return fit_multi_metrics(spark, SAMPLE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    known = {q.__name__: q for q in QUERIES}
    if llm_queries:
        known |= {q.__name__: q for q in llm_queries.QUERIES}
    if corpus_pipeline:
        known["pipeline"] = corpus_pipeline.run
    return known


def oracle_sql() -> dict[str, str]:
    known = dict(ORACLES)
    if llm_sql:
        known |= llm_sql.ORACLES
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        known["pipeline"] = corpus_pipeline.ORACLE_SQL
    return known
