"""Redaction rules from a file or a folder of files, and their refresh between micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.redact import RuleSet, parse_rules
from logloom.operators.ruletable import RuleTable, compile_rules

_HINTS = [T.StructField("HintCharsStart", T.IntegerType()), T.StructField("HintCharsEnd", T.IntegerType())]
RULES = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField(
                "StaticRules",
                T.ArrayType(T.StructType([T.StructField("Name", T.StringType()), T.StructField("Regex", T.StringType()), *_HINTS])),
            ),
            T.StructField(
                "JsonPathRules",
                T.ArrayType(T.StructType([T.StructField("Name", T.StringType()), T.StructField("Path", T.StringType()), *_HINTS])),
            ),
        ]
    ),
)


def rules_table(texts: DataFrame, column: str = "value") -> DataFrame:
    """Typed rules, one row per application, from JSON rule texts; a text that cannot be read is a row without an application."""
    return texts.select(F.explode_outer(F.from_json(column, RULES)).alias("app", "_rules")).select("app", "_rules.*")


def load_rules(spark: SparkSession, path: str) -> dict[str, RuleSet]:
    """Rules of all applications; a bad pattern fails here, before a job starts."""
    texts = spark.read.text(path, wholetext=True)
    rules: dict[str, RuleSet] = {}
    for row in texts.collect():
        rules.update(parse_rules(row.value))
    return rules


def load_rule_table(spark: SparkSession, path: str) -> RuleTable:
    """The rules of all applications as a table: nothing passes through the driver, bad rules are set aside."""
    return compile_rules(rules_table(spark.read.text(path, wholetext=True)))


class LiveRules:
    """Rules re-read before each micro-batch; the last good set stays in force when a read fails.

    With ``as_table`` they are a rule table, for many applications. Then a bad rule or text is only set
    aside, and a read fails if nothing at all could be read.
    """

    def __init__(self, spark: SparkSession, path: str, as_table: bool = False):
        self._spark, self._path, self._as_table = spark, path, as_table
        self.current = self._load()
        self.last_error: Exception | None = None

    def _load(self):
        if not self._as_table:
            return load_rules(self._spark, self._path)
        table = load_rule_table(self._spark, self._path)
        if table.rules.isEmpty() and not table.refused.isEmpty():
            raise ValueError(f"no rules could be read from {self._path}")
        return table

    def refresh(self):
        try:
            self.current, self.last_error = self._load(), None
        except Exception as error:  # noqa: BLE001 - any failed read keeps the old rules
            self.last_error = error
        return self.current
