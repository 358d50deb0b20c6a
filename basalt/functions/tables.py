"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from basalt.functions import c_source


@F.udtf(returnType="function_name string, source_code string, comment string", useArrow=True)
class CFunctions:
    """Functions of a C file's text: `SELECT f.file_path, c.* FROM files f, LATERAL c_functions(f.text) c`. A null or empty text has none."""

    def eval(self, text: str):
        yield from c_source.functions(text or "", True)


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL: c_functions(text)."""
    spark.udtf.register("c_functions", CFunctions)
