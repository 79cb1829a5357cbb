"""User code: SQL functions, scripts over rows, and pipelines of named steps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Functions:
    """Named SQL functions and scripts of a session; a script is known by the SHA-1 of its text, too."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.scripts: dict[str, str] = {}

    def load(self, name: str, parameters: str, returns: str, body: str) -> None:
        """A SQL function: Catalyst inlines it, no Python runs."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")

    def delete(self, name: str) -> None:
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    def script(self, expression: str) -> str:
        sha = hashlib.sha1(expression.encode()).hexdigest()
        self.scripts[sha] = expression
        return sha

    def evaluate(self, df: DataFrame, script: str, output: str = "value") -> DataFrame:
        """A script, or its SHA-1, as a column over rows."""
        return df.withColumn(output, F.expr(self.scripts.get(script, script)))


Step = Callable[[DataFrame], DataFrame]


class Pipeline:
    """Named steps from DataFrame to DataFrame, with hooks before and after; nothing runs until an action."""

    def __init__(self, name: str) -> None:
        self.name, self.steps = name, []
        self.before: list[Step] = []
        self.after: list[Step] = []

    def add(self, name: str, step: Step) -> Pipeline:
        self.steps.append((name, step))
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in [*self.before, *(s for _, s in self.steps), *self.after]:
            df = df.transform(step)
        return df
