"""Aggregations over outcomes: one pass each, partial sums before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(n: Column, of: Column) -> Column:
    """n / of, 0 where there is nothing."""
    return F.coalesce(F.try_divide(n, of), F.lit(0.0))


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn and their rates; truth and predicted are boolean."""
    t, p = F.col(truth), F.col(predicted)
    n = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return confusion_rates(n)


def confusion_rates(counts: DataFrame) -> DataFrame:
    """Rates of rows (tp, fp, fn, tn)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    over = lambda a, b: a / F.greatest(F.lit(1.0), b)
    precision, recall, specificity = over(tp, tp + fp), over(tp, tp + fn), over(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns(
        {
            "accuracy": over(tp + tn, tp + tn + fp + fn),
            "precision": precision,
            "recall": recall,
            "specificity": specificity,
            "balanced_accuracy": (recall + specificity) / 2,
            "f1": 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8)),
            "mcc": F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0),
        }
    )


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """One row of rows (status, truth_found, predicted_number, number_match, verification_status)."""
    done = F.col("status") == "evaluated"
    scored, found = done & F.col("truth_found"), done & (F.col("predicted_number") != "")
    correct = scored & F.col("number_match")
    n = rows.agg(
        F.count("*").alias("total_files"),
        F.count_if(done).alias("evaluated_files"),
        F.count_if(F.col("status") == "skipped_non_4page").alias("skipped_non_4page"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(scored).alias("truth_rows_matched"),
        F.count_if(found).alias("predicted_found"),
        F.count_if(correct).alias("exact_matches"),
        F.count_if(scored & found).alias("scored_found"),
        *(F.count_if(done & (F.col("verification_status") == s)).alias(s) for s in ("green", "yellow", "red")),
    )
    rate = lambda a, b: F.round(share(F.col(a), F.col(b)), 4)
    return n.withColumns({"accuracy_vs_truth": rate("exact_matches", "truth_rows_matched"), "found_rate": rate("predicted_found", "evaluated_files"), "accuracy_when_found": rate("exact_matches", "scored_found")})


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """column, n and percent; the total comes from the groups, not from a second scan."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), F.lit(True)).select(column, "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def most_common(rows: DataFrame, column: str, order: str) -> DataFrame:
    """column, n: by count, equal ones by who comes first."""
    return rows.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_ord")).orderBy(F.desc("n"), "first_ord")


def text_metrics(rows: DataFrame) -> DataFrame:
    """exact, first-last, character error rate of rows (expected, predicted), both in normal form."""
    from ..functions.names import first_last_equal
    from ..functions.text import overlap, tokens

    e, p = F.col("expected"), F.col("predicted")
    return rows.agg(
        F.count("*").alias("n"),
        F.avg((e == p).cast("double")).alias("exact"),
        F.avg(first_last_equal(e, p).cast("double")).alias("first_last"),
        F.avg(overlap(e, p).cast("double")).alias("mean_overlap"),
        (F.sum(F.levenshtein(e, p)) / F.greatest(F.lit(1), F.sum(F.char_length(e)))).alias("cer"),
        F.sum(F.size(tokens(e))).alias("words"),
    )


def number_metrics(rows: DataFrame) -> DataFrame:
    """exact, exact by digits alone, character error rate."""
    from ..functions.text import digits

    e, p = F.col("expected"), F.col("predicted")
    return rows.agg(
        F.count("*").alias("n"),
        F.avg((e == p).cast("double")).alias("exact"),
        F.avg((digits(e) == digits(p)).cast("double")).alias("digit_exact"),
        (F.sum(F.levenshtein(e, p)) / F.greatest(F.lit(1), F.sum(F.char_length(e)))).alias("cer"),
    )


def mixed_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy by task (labels of digits are numbers, others names) and the pooled error rate."""
    e, p = F.col("expected"), F.col("predicted")
    number = e.rlike(r"\A[0-9]+\z")
    same = F.when(number, e == p).otherwise(F.lower(e) == F.lower(p))
    return rows.agg(
        F.count_if(number).alias("numbers"),
        F.count_if(~number).alias("names"),
        share(F.count_if(number & same), F.count_if(number)).alias("number_accuracy"),
        share(F.count_if(~number & same), F.count_if(~number)).alias("name_accuracy"),
        (F.sum(F.levenshtein(F.lower(e), F.lower(p))) / F.greatest(F.lit(1), F.sum(F.char_length(e)))).alias("cer"),
    )


def fold_summary(rows: DataFrame, value: str) -> DataFrame:
    """Mean and sample deviation over folds, 0 for one fold."""
    return rows.agg(F.count("*").alias("folds"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"))


def leaderboard(rows: DataFrame, k: int = 5) -> DataFrame:
    """Best runs by eval, then test balanced accuracy."""
    return rows.orderBy(F.desc("eval_balanced_accuracy"), F.desc("test_balanced_accuracy"), "run").limit(k)


def loss_board(rows: DataFrame, k: int = 5) -> DataFrame:
    """Runs of the least loss, by name where it is equal; runs without a loss aren't ranked."""
    return rows.where(F.col("loss").isNotNull() & ~F.isnan("loss")).orderBy(F.asc("loss"), "run").limit(k)


def grid(**axes: DataFrame) -> DataFrame:
    """Every combination of a few settings: the axes are small tables of parameters."""
    out = None
    for axis in axes.values():
        out = axis if out is None else out.crossJoin(F.broadcast(axis))
    return out
