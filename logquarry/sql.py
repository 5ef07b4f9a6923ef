"""Scalar functions of the library as SQL functions, and the line table as a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.functions import text as tx
from logquarry.functions.secrets import has_secret, mask_secrets


def functions() -> dict[str, object]:
    """SQL name to Column function, all of one text argument."""
    return {
        "log_signature": tx.signature,
        "log_normalize": tx.normalize_line,
        "log_normalize_whitespace": tx.normalize_whitespace,
        "log_strip_ansi": tx.strip_ansi,
        "log_has_secret": has_secret,
        "log_mask": mask_secrets,
        "log_quote_csv": tx.quote_csv,
        "log_base64_encode": tx.base64_encode,
        "log_base64_decode": tx.base64_decode,
        "log_url_encode": tx.url_encode,
        "log_url_decode": tx.url_decode,
        "log_unique_lines": tx.unique_lines,
    }


def register(spark: SparkSession) -> None:
    """Make the functions usable in SQL as temporary SQL functions: Catalyst inlines them, no Python runs.

    Levels and times need the whole line table; ``register_lines`` has them as columns.
    """
    for name, make in functions().items():
        df = spark.sql("SELECT '' AS x").select(make(F.col("x")).alias("y"))
        body = df._jdf.queryExecution().analyzed().expressions().head().child().sql()
        kind = df.schema["y"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")


def register_lines(df: DataFrame, name: str = "lines") -> None:
    df.createOrReplaceTempView(name)
