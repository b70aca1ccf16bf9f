"""Chi-square tests and classifier accuracy: counts in Spark, closed forms on the handful of counted rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.labels import chart_group
from mailposture.operators.reports import has_gateway, n_rows, true, valid_scans

ERFC_TERMS = 60


def chi_square_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of the table [[a, b], [c, d]] with continuity correction; 0 when a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    corrected = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.when(margins > 0, n * corrected * corrected / margins).otherwise(F.lit(0.0))


def p_value(chi2: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, ``erfc(sqrt(chi2 / 2))``.

    A power series below 3 and a continued fraction above, evaluated on the few result rows as plain expressions.
    """
    x = F.sqrt(chi2 / 2)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(ERFC_TERMS)),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda acc, n: F.struct(
            (acc["term"] * (-1) * x * x / n).alias("term"), (acc["sum"] + acc["term"] * (-1) * x * x / n / (n * 2 + 1)).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    fraction = F.aggregate(
        F.reverse(F.sequence(F.lit(1), F.lit(ERFC_TERMS))), F.lit(0.0), lambda acc, n: (n / 2.0) / (x + acc)
    )
    small = F.lit(1.0) - series * (2 / math.sqrt(math.pi))
    large = F.exp(-x * x) / (x + fraction) / math.sqrt(math.pi)
    return F.when(x < 2, small).otherwise(large)


def _tests(rows: DataFrame, in_group: Column, metrics: list[str]) -> DataFrame:
    """One row per metric with the four counts of its table; all metrics from one pass."""
    aggs = [n_rows().alias("n")]
    for m in metrics:
        aggs += [
            F.count_if(in_group & ~true(m)).alias(f"a_{m}"),
            F.count_if(in_group & true(m)).alias(f"b_{m}"),
            F.count_if(~in_group & ~true(m)).alias(f"c_{m}"),
            F.count_if(~in_group & true(m)).alias(f"d_{m}"),
        ]
    items = [
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{x}_{m}").alias(x) for x in "abcd"]) for m in metrics
    ]
    long = rows.agg(*aggs).select("n", F.explode(F.array(*items)).alias("t")).select("n", "t.*")
    a, b, c, d = (F.col(x) for x in "abcd")
    # An empty column of the table is degenerate; so is a single row, for which the library reports no freedom.
    no_column = ((a + c) == 0) | ((b + d) == 0)
    one_row = ((a + b) == 0) | ((c + d) == 0)
    chi2 = chi_square_yates(a, b, c, d)
    return (
        long.withColumn("chi2", chi2)
        .withColumn("p", F.when(no_column | one_row, F.lit(1.0)).otherwise(p_value(F.col("chi2"))))
        .withColumn("dof", F.when(one_row & ~no_column, 0).otherwise(1))
    )


def chi_square_provider(export: DataFrame) -> DataFrame:
    """Independence of hosting group (domestic, US cloud) and each security metric."""
    group = chart_group(F.col("category"))
    rows = valid_scans(export).filter(group.isin("Domestic", "US Cloud"))
    return _tests(rows, group == "Domestic", dims.SECURITY_METRICS).select("metric", "chi2", "p", "dof", "n")


def chi_square_gateway(export: DataFrame) -> DataFrame:
    """Independence of gateway use and each metric, with the difference in percentage points."""
    rows = _tests(valid_scans(export), ~has_gateway(), dims.SECURITY_METRICS[:4])
    without, with_gw = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    share = lambda part, whole: F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
    delta = share(F.col("d"), with_gw) - share(F.col("b"), without)
    return rows.withColumn("delta_pp", delta).select("metric", "chi2", "p", "dof", "n", "delta_pp")


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts per (truth, predicted); rows without a truth are probes without a reply and left out."""
    return pairs.filter(F.col("truth").isNotNull()).groupBy("truth", "predicted").agg(n_rows().alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class of the truth, from a confusion matrix."""
    truth = matrix.groupBy(F.col("truth").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits")
    )
    predicted = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    rows = truth.join(predicted, "label", "left")
    precision = F.coalesce(F.col("hits") / F.col("predicted"), F.lit(0.0))
    recall = F.col("hits") / F.col("support")
    f1 = F.when(precision + recall > 0, precision * recall * 2 / (precision + recall)).otherwise(F.lit(0.0))
    return rows.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.col("support").cast("bigint").alias("support"))


def classification_metrics(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """One row: probes, replies, response rate, accuracy over all classes, and F1 weighted by support.

    The weighted F1 looks only at pairs whose truth and prediction are both among ``labels``.
    """
    sent = pairs.agg(n_rows().alias("sent"), F.count("truth").alias("replies"))
    matrix = confusion(pairs)
    overall = matrix.agg(
        (F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")
    )
    inner = class_metrics(matrix.filter(F.col("truth").isin(labels) & F.col("predicted").isin(labels)))
    weighted = inner.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    rows = sent.crossJoin(F.broadcast(overall)).crossJoin(F.broadcast(weighted))
    return rows.select("sent", "replies", (F.col("replies") / F.col("sent")).alias("response_rate"), "accuracy", "weighted_f1")
