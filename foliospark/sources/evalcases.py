"""Evaluation cases: a JSON array of files with questions and true answers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(format, file, nth, question, truth); field names in any case."""
    rows = spark.read.option("multiLine", "true").json(path)
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    fields = {f.name.lower(): f.name for f in rows.schema["questions"].dataType.elementType.fields}
    each = rows.select("format", "file", F.posexplode("questions").alias("nth", "x"))
    return each.select("format", "file", "nth", F.col("x")[fields["q"]].alias("question"), F.col("x")[fields["truth"]].alias("truth"))
