"""Masked losses, evaluation loss, perplexity, history and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.scores import as_double_array, cross_entropy


def token_losses(logits: DataFrame, z: str = "z", label: str = "label", smoothing: float = 0.0,
                 out: str = "loss") -> DataFrame:
    """Per-token cross entropy (narrow, codegen'd)."""
    return logits.withColumn(out, cross_entropy(as_double_array(F.col(z)), F.col(label), smoothing))


def batch_losses(scored: DataFrame, batch: str = "batch_id", loss: str = "loss",
                 mask: str = "mask") -> DataFrame:
    """Masked mean per batch: ``sum(loss*mask) / sum(mask)``; NULL when no token counts.

    A plain grouped sum: partial aggregation map-side, so one huge batch does
    not funnel rows into one task.
    """
    return scored.groupBy(batch).agg(
        F.try_divide(F.sum(F.col(loss) * F.col(mask)), F.sum(F.col(mask)).cast("double")).alias("batch_loss"),
        F.sum(F.col(mask)).cast("long").alias("n_tokens"),
    )


def evaluation_loss(batches: DataFrame) -> DataFrame:
    """Unweighted mean of batch means (batches with no counted token are skipped
    and reported), plus the token-weighted mean under its own name."""
    return batches.agg(
        F.avg("batch_loss").alias("eval_loss"),
        F.try_divide(F.sum(F.col("batch_loss") * F.col("n_tokens")),
                     F.sum(F.when(F.col("batch_loss").isNotNull(), F.col("n_tokens"))).cast("double"))
        .alias("token_weighted_loss"),
        F.count(F.lit(1)).alias("n_batches"),
        F.sum(F.when(F.col("batch_loss").isNull(), 1).otherwise(0)).alias("n_empty_batches"),
    ).withColumn("perplexity", F.exp("eval_loss"))


def history(train_batches: DataFrame, val_loss, eval_steps: int, batch_size: int, epoch: int = 0) -> DataFrame:
    """One row per evaluated batch: ``(epoch, step, loss, val_loss)``.

    ``val_loss`` is the evaluation loss at that point: a number, or a column such as a scalar subquery
    (``evaluation_loss(...).select("eval_loss").scalar()``), which stays inside the plan.
    """
    from lexiframe.operators.batches import cadence

    at = cadence(train_batches, eval_steps, batch_size)
    val = val_loss if isinstance(val_loss, Column) else F.lit(val_loss)
    return at.select(F.lit(epoch).alias("epoch"), "step", F.col("batch_loss").alias("loss"),
                     val.cast("double").alias("val_loss"))


def results(hist: DataFrame, test_loss: DataFrame, test_bleu: DataFrame | None = None) -> DataFrame:
    """Test loss and the last history row's validation loss, and ``test_bleu`` when given (a frame with
    ``bleu``), in one aggregation over the union of the inputs (no join)."""
    none = F.lit(None).cast("double")
    rows = hist.select("step", "val_loss", none.alias("test_loss"), none.alias("test_bleu"))
    step = F.lit(None).cast("long").alias("step")
    rows = rows.unionByName(test_loss.select(step, none.alias("val_loss"), F.col("eval_loss").alias("test_loss"),
                                             none.alias("test_bleu")))
    fields = [F.max_by("val_loss", "step").alias("val_loss"), F.max("test_loss").alias("test_loss")]
    if test_bleu is not None:
        rows = rows.unionByName(test_bleu.select(step, none.alias("val_loss"), none.alias("test_loss"),
                                                 F.col("bleu").alias("test_bleu")))
        fields.append(F.max("test_bleu").alias("test_bleu"))
    return rows.agg(*fields)


def score_batches(batches: DataFrame, scorer, schema: str, batch: str = "batch_id", resident: bool = False,
                  dealt: bool = False) -> DataFrame:
    """Run a user-supplied scorer over each padded batch (a pandas frame of at
    most ``batch_size`` rows) and return its per-token rows, e.g.
    ``batch_id long, seq_id long, pos int, loss double, mask int``.

    Rows are dealt by batch and sorted, and each task cuts its batches from one
    stream of frames, so the scorer gets the rows of one batch, in slot order
    if there are slots.  ``resident``: ``scorer`` loads a model and returns the
    function that scores a batch; it is called once a task.  ``dealt``: the
    rows of a batch are together already (``pad_batches(by_batch=True)``), so no exchange is added.
    """
    order = [c for c in (batch, "slot") if c in batches.columns]
    rows = (batches if dealt else batches.repartition(batch)).sortWithinPartitions(*order)

    def run(frames):
        import pandas as pd

        score = scorer() if resident else scorer
        held: list = []  # the parts of the batch that the last frame ended with
        for pdf in frames:
            ids = pdf[batch].to_numpy()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for s, e in zip(cuts, cuts[1:]):
                if held and held[-1][batch].iloc[0] != ids[s]:
                    yield score(pd.concat(held, ignore_index=True))
                    held = []
                held.append(pdf.iloc[s:e])
        if held:
            yield score(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(run, schema)
