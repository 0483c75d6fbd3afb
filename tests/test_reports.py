from pyspark.sql import functions as F

from ragspark.operators import reports


def test_redaction_report_sorts_its_lists(spark):
    """Types by name, causes by falling count and then by name; a report without any masks still has its head."""
    rows = [
        ("recall", "NAME", 1, 2, 0.5), ("recall", "CARD", 3, 3, 1.0), ("recall", "overall", 4, 5, 0.8), ("masks", "precision", 4, 10, 0.4),
        ("masks", "over_mask_rate", 6, 10, 0.6), ("false_positives", "spurious", 2, 2, 1.0), ("false_positives", "ORG", 2, 2, 1.0), ("false_positives", "REF", 3, 3, 1.0),
    ]
    report = spark.createDataFrame(rows, "section string, label string, hits long, total long, value double")
    lines = [r.line for r in reports.redaction_report(report, spark.range(7)).orderBy("line_no").collect()]
    assert lines == [
        "# Redaction quality", "Cases: 7", "| Type | Recall | Found/All |", "|---|---:|---:|", "| CARD | 100% | 3/3 |", "| NAME | 50% | 1/2 |", "| overall | 80% | 4/5 |",
        "- Masks: 10 (right 4, wrong 6)", "- Precision: 40%", "- Over-mask rate: 60%", "Wrong masks by cause:", "- REF: 3", "- ORG: 2", "- spurious: 2",
    ]
    empty = [r.line for r in reports.redaction_report(report.where(F.lit(False)), spark.range(0)).orderBy("line_no").collect()]
    assert empty == ["# Redaction quality", "Cases: 0", "| Type | Recall | Found/All |", "|---|---:|---:|", "Wrong masks by cause:"]
