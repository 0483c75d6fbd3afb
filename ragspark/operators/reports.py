"""Reports as tables of numbered lines: ``line_no, line``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.operators.metrics import drafting_comparison
from ragspark.operators.ranking import number_rows

# Columns of the comparison table.
DRAFTING_HEAD = ["Config", "Coverage", "Section P", "Citation P/R", "Retr. Recall", "Gap", "Grounded %", "Agreement"]


def _whole_percent(value: Column) -> Column:
    return F.format_string("%.0f%%", value * 100)


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _fixed(spark: SparkSession, lines: dict[int, str]) -> DataFrame:
    rows = [(part, 0, "", line) for part, line in lines.items()]
    return spark.createDataFrame(rows, "part int, place long, label string, line string")


def _at(part: int, line: Column, place: Column | None = None, label: Column | None = None) -> list[Column]:
    """Columns of a line: parts follow each other, and within one the place and then the label decide."""
    return [
        F.lit(part).alias("part"), (F.lit(0) if place is None else place).cast("long").alias("place"),
        (F.lit("") if label is None else label).alias("label"), line.alias("line"),
    ]


def _numbered(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return number_rows(every, [], [F.col("part"), F.col("place"), F.col("label")], "line_no").select("line_no", "line")


def redaction_report(report: DataFrame, cases: DataFrame) -> DataFrame:
    """Lines of a redaction evaluation from the rows of :func:`pii_eval.report` and its cases.

    Recall is listed by type, false positives by falling count and then by cause.
    """
    of = lambda section: report.where(F.col("section") == section)
    share = F.concat_ws("/", F.col("hits").cast("string"), F.col("total").cast("string"))
    recall, wrong = _row(F.col("label"), _whole_percent(F.col("value")), share), F.col("total") - F.col("hits")
    precise, over = of("masks").where("label = 'precision'"), of("masks").where("label = 'over_mask_rate'")
    return _numbered(
        _fixed(report.sparkSession, {0: "# Redaction quality", 2: "| Type | Recall | Found/All |", 3: "|---|---:|---:|", 9: "Wrong masks by cause:"}),
        cases.agg(F.count("*").alias("n")).select(*_at(1, F.format_string("Cases: %d", "n"))),
        of("recall").where("label <> 'overall'").select(*_at(4, recall, label=F.col("label"))),
        of("recall").where("label = 'overall'").select(*_at(5, recall)),
        precise.select(*_at(6, F.format_string("- Masks: %d (right %d, wrong %d)", "total", "hits", wrong))),
        precise.select(*_at(7, F.concat(F.lit("- Precision: "), _whole_percent(F.col("value"))))),
        over.select(*_at(8, F.concat(F.lit("- Over-mask rate: "), _whole_percent(F.col("value"))))),
        of("false_positives").select(*_at(10, F.format_string("- %s: %d", "label", "hits"), -F.col("hits"), F.col("label"))),
    )


def drafting_report(aggregate: DataFrame) -> DataFrame:
    """Comparison table of the arms with its head and the sample size of the first arm."""
    head = {0: "# Drafting evaluation", 1: f"| {' | '.join(DRAFTING_HEAD)} |", 2: "|" + "---|" * len(DRAFTING_HEAD)}
    size = aggregate.agg(F.coalesce(F.min_by("n_scenarios", "config_label"), F.lit(0)).alias("n"))
    return _numbered(
        _fixed(aggregate.sparkSession, head),
        drafting_comparison(aggregate).select(*_at(3, F.col("line"), label=F.col("config_label"))),
        size.select(*_at(4, F.format_string("Scenarios per configuration: %d", "n"))),
    )
