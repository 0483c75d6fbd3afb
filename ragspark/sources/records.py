"""Ground truth, audit trail and result tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark import schemas


def _limited(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    return df.orderBy(key).limit(limit) if limit else df


def read_scenarios(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return _limited(spark.read.schema(schemas.SCENARIOS).option("multiLine", True).json(path), "scenario_id", limit)


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return _limited(spark.read.schema(schemas.QA_PAIRS).option("multiLine", True).json(path), "question_id", limit)


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """Rubric definitions, one row per element."""
    raw = spark.read.schema(schemas.RUBRIC_FILE).option("multiLine", True).json(path)
    return raw.select(F.explode("elements").alias("key", "block")).select("key", "block.*")


def read_pii_cases(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.PII_CASES_FILE).option("multiLine", True).json(path)
    cases = raw.select(F.explode("cases").alias("c")).select("c.*")
    return cases.withColumns({
        "source": F.coalesce("source", F.lit("synthetic")),
        "entities": F.transform(
            F.coalesce("entities", F.array().cast("array<struct<text:string,type:string,is_pii:boolean>>")),
            lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type"),
                               F.coalesce(e["is_pii"], F.lit(True)).alias("is_pii")),
        ),
    })


def append_audit(records: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    records.write.mode("append").json(path)


def _read_or_empty(spark: SparkSession, path: str, schema, reader) -> DataFrame:
    try:
        return reader(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The audit trail; blank lines are skipped and a missing path is an empty trail."""
    return _read_or_empty(spark, path, schemas.AUDIT, spark.read.schema(schemas.AUDIT).json)


def remaining_work(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows not yet recorded. A failed record carries its id and so counts as done."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def work_matrix(items: DataFrame, configs: list[tuple[str, str]]) -> DataFrame:
    """Every item under every configuration; the configurations are a literal list."""
    arms = F.array(*[
        F.struct(F.lit(c).alias("chunking"), F.lit(e).alias("embedding"), F.lit(f"{c}-{e}").alias("config_label"))
        for c, e in configs
    ])
    return items.withColumn("_arm", F.explode(arms)).select("*", "_arm.*").drop("_arm")


def write_run(table: DataFrame, path: str, run_ts: str, mode: str = "error") -> None:
    """One evaluation run of a result table under its time stamp."""
    table.write.mode(mode).parquet(f"{path}/run_ts={run_ts}")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest run of a result table; only its partition is scanned."""
    table = spark.read.option("basePath", path).parquet(path)
    newest = table.select(F.max(F.col("run_ts").cast("string")).alias("_newest"))
    return table.join(F.broadcast(newest), F.col("run_ts").cast("string") == F.col("_newest")).drop("_newest")


def write_curated(rows: DataFrame, path: str, gate: str) -> None:
    """Curated, candidate and failed tables from one gated frame, which is computed once: the two subsets are read from the candidates."""
    rows.write.mode("overwrite").parquet(f"{path}/candidates")
    candidates = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/candidates")
    for name, verdict in (("curated", "pass"), ("failed", "fail")):
        candidates.where(F.col(gate) == verdict).write.mode("overwrite").parquet(f"{path}/{name}")
