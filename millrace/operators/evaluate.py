"""Scores of WAIT / ANSWER predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LABELS, known

#: Numerator and denominator of each rate.
RATES = {
    "overall_accuracy": ("correct", "total"),
    "wait_accuracy": ("wait_correct", "wait_count"),
    "premature_answer_rate": ("premature_answer", "wait_count"),
    "wait_other_rate": ("wait_other", "wait_count"),
    "answer_accuracy": ("answer_correct", "answer_count"),
    "over_wait_rate": ("over_wait", "answer_count"),
    "answer_other_rate": ("answer_other", "answer_count"),
}


def counts() -> dict[str, Column]:
    """Confusion counts over ``gt_label, pred_label, correct_answerability``."""
    gt, pred = known(F.col("gt_label")), known(F.col("pred_label"))
    other = pred.isin("OTHER", "ERROR")
    both = lambda g, p: F.count_if((gt == g) & p)
    out = {
        "total": F.count("*"), "correct": F.count_if(F.coalesce("correct_answerability", F.lit(False))),
        "wait_count": F.count_if(gt == "WAIT"), "wait_correct": both("WAIT", pred == "WAIT"), "premature_answer": both("WAIT", pred == "ANSWER"), "wait_other": both("WAIT", other),
        "answer_count": F.count_if(gt == "ANSWER"), "answer_correct": both("ANSWER", pred == "ANSWER"), "over_wait": both("ANSWER", pred == "WAIT"), "answer_other": both("ANSWER", other),
    }
    for label in LABELS:
        out |= {f"gt_{label.lower()}": F.count_if(gt == label), f"pred_{label.lower()}": F.count_if(pred == label)}
    return out


def with_rates(table: DataFrame) -> DataFrame:
    return table.withColumns({name: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) for name, (a, b) in RATES.items()})


def summary(rows: DataFrame) -> DataFrame:
    """One row over all predictions."""
    return with_rates(rows.agg(*[c.alias(n) for n, c in counts().items()]))


def report(rows: DataFrame) -> DataFrame:
    """Overall, by sample type and by question type, in one pass of grouping sets; null types are called None."""
    named = rows.withColumns({c: F.coalesce(F.col(c), F.lit("None")) for c in ("sample_type", "qa_type")})
    level = F.when(F.grouping("sample_type") == 0, "sample_type").when(F.grouping("qa_type") == 0, "qa_type").otherwise("overall")
    key = F.coalesce("sample_type", "qa_type", F.lit("all"))
    sets = named.groupingSets([[F.col("sample_type")], [F.col("qa_type")], []], F.col("sample_type"), F.col("qa_type"))
    return with_rates(sets.agg(level.alias("level"), *[c.alias(n) for n, c in counts().items()]).withColumn("key", key).drop("sample_type", "qa_type"))


def failures(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` wrong rows by ``idx``; even 0 shows one if the very first row is wrong."""
    wrong = rows.where(~F.coalesce("correct_answerability", F.lit(False)))
    if n > 0:
        return wrong.orderBy("idx").limit(n)
    return rows.orderBy("idx").limit(1).where(~F.coalesce("correct_answerability", F.lit(False)))
