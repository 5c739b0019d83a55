"""Classification metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators.segments import ROWS_PER_CUT, even_cuts, running_sums
from flowtide.session import materialize


def _share(part: Column, whole: Column) -> Column:
    """``part / whole``, zero where the whole is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_matrix(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Counts for every pair of classes that occur on either side, zeros included.

    The pairs come from the aggregated class list (one array), so the filling never touches rows.
    """
    cells = df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    classes = cells.select(F.explode(F.array("truth", "prediction")).alias("c")).agg(
        F.collect_set("c").alias("classes")
    )
    grid = classes.select(F.explode("classes").alias("truth"), "classes").select(
        "truth", F.explode("classes").alias("prediction")
    )
    return grid.join(cells, ["truth", "prediction"], "left").select(
        "truth", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def binary_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1, in one pass."""
    t, p = F.col(truth) == 1, F.col(prediction) == 1
    sums = df.agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(F.col(truth) == F.col(prediction)).alias("hits"),
        F.count(F.lit(1)).alias("n"),
    )
    precision = _share(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _share(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        _share(F.col("hits"), F.col("n")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def _class_table(df: DataFrame, keys: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """Per group and class: support, predicted and hits, from one pass of two tagged copies."""
    sides = F.array(
        F.struct(F.col(truth).alias("cls"), F.lit(1).alias("is_truth")),
        F.struct(F.col(prediction).alias("cls"), F.lit(0).alias("is_truth")),
    )
    hit = F.col(truth) == F.col(prediction)
    return (
        df.select(*keys, hit.alias("hit"), F.inline(sides))
        .groupBy(*keys, "cls")
        .agg(
            F.sum("is_truth").alias("support"),
            F.count_if(F.col("is_truth") == 0).alias("predicted"),
            F.count_if((F.col("is_truth") == 1) & F.col("hit")).alias("hits"),
        )
    )


def weighted_metrics(df: DataFrame, keys: Sequence[str], truth: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 per group."""
    table = _class_table(df, keys, truth, prediction)
    precision = _share(F.col("hits"), F.col("predicted"))
    recall = _share(F.col("hits"), F.col("support"))
    f1 = _share(2 * F.col("hits"), F.col("support") + F.col("predicted"))

    def weighted(score: Column) -> Column:
        return F.sum(score * F.col("support")) / F.sum("support")

    return table.groupBy(*keys).agg(
        _share(F.sum("hits"), F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision"),
        weighted(recall).alias("recall"),
        weighted(f1).alias("f1"),
    )


def voters_long(df: DataFrame, voters: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per voter: its name and prediction."""
    return df.select(
        *keep,
        F.inline(
            F.array(*[F.struct(F.lit(v).alias("classifier"), F.col(v).alias("prediction")) for v in voters])
        ),
    )


def cv_scores(df: DataFrame, fold: str, truth: str, prediction: str) -> DataFrame:
    """Balanced accuracy and weighted F1 per fold."""
    table = _class_table(df, [fold], truth, prediction)
    balanced = table.where(F.col("support") > 0).groupBy(fold).agg(
        F.avg(F.col("hits") / F.col("support")).alias("balanced_accuracy")
    )
    weighted = weighted_metrics(df, [fold], truth, prediction).select(fold, F.col("f1").alias("weighted_f1"))
    return balanced.join(weighted, fold)


def pr_curve(df: DataFrame, cls: str, score: str, positive: str, bins: int | None = None, rows: int = ROWS_PER_CUT) -> DataFrame:
    """One-vs-rest precision-recall points per class, one per distinct score (a threshold),
    and the closing point (precision 1, recall 0).

    Rows collapse to one per distinct score before any ordering, and each class's scores are
    then summed in segments of about ``rows`` of them, cut finer where scores crowd. ``bins`` rounds scores down to 1/bins first.
    """
    value = F.floor(F.col(score) * bins) / bins if bins else F.col(score)
    points = df.groupBy(F.col(cls).alias("class_id"), value.alias("threshold")).agg(
        F.sum(F.col(positive).cast("long")).alias("tp_here"), F.count(F.lit(1)).alias("n_here")
    )
    totals = points.groupBy("class_id").agg(F.sum("tp_here").alias("positives"))
    # Descending order: cuts are made along the negated threshold so that they do not decrease along it.
    points = materialize(points.withColumn("__down", -F.col("threshold")), "pr-points")
    summed = running_sums(
        even_cuts(points, "__down", rows=rows), ["class_id"], F.col("__cut"), [F.col("__down")], {"tp": "tp_here", "predicted": "n_here"}
    )
    curve = summed.join(totals, "class_id").select(
        "class_id",
        "threshold",
        (F.col("tp") / F.col("predicted")).alias("precision"),
        F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(F.lit(1.0)).alias("recall"),
    )
    closing = totals.select(
        "class_id", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return curve.unionByName(closing)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced class weights ``n / (k * n_c)``."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    # One row per class, gathered into one array to meet the totals.
    gathered = counts.agg(
        F.collect_list(F.struct("label", "n")).alias("classes"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")
    )
    return gathered.select(F.inline("classes"), "total", "k").select(
        "label", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight")
    )


def best_params(results: DataFrame, score: str, order: Sequence[str]) -> DataFrame:
    """The row with the highest score; ties go to the smallest ``order`` columns."""
    ranking = F.struct(-F.col(score), *[F.col(c) for c in order])
    return results.agg(F.min_by(F.struct(*results.columns), ranking).alias("best")).select("best.*")
