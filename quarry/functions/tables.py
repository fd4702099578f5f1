"""Table functions for SQL: call ``register(spark)``, then ``FROM t, LATERAL word_windows(t.text, 100)`` or ``sessions(TABLE(t) PARTITION BY user ORDER BY ts)``."""

from __future__ import annotations

import datetime

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf


class WordWindows:
    """``start, n_words, words``: a text's words (runs without white space) in windows of a fixed number; a null or blank text has none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not size.isConstantExpression or size.value is None or int(size.value) < 1:
            raise ValueError("the window's size must be a constant of at least 1")
        if not isinstance(text.dataType, T.StringType | T.NullType):
            raise ValueError("a text is asked for")
        return AnalyzeResult(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("words", T.StringType())]))

    def eval(self, text: str | None, size: int):
        words = (text or "").split()
        for at in range(0, len(words), size):
            part = words[at : at + size]
            yield at, len(part), " ".join(part)


class Sessions:
    """``key, session, started_at, ended_at, n``: rows of one key, in order of time, cut where ``gap`` seconds pass without one.

    The table must have ``key`` and ``at``; it is partitioned by the one and ordered by the other, and a session is all
    that is held. Rows without time are no session's.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in table.dataType.fields} if isinstance(table.dataType, T.StructType) else {}
        if not {"key", "at"} <= kinds.keys():
            raise ValueError("a table with the columns key and at is asked for")
        out = T.StructType([T.StructField("key", kinds["key"]), T.StructField("session", T.LongType()), T.StructField("started_at", kinds["at"]), T.StructField("ended_at", kinds["at"]), T.StructField("n", T.LongType())])
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("at")])

    def __init__(self) -> None:
        self.key, self.number, self.first, self.last, self.n = None, 0, None, None, 0

    def eval(self, row: T.Row, gap: int):
        at = row["at"]
        if at is None:
            return
        if self.n and at - self.last > datetime.timedelta(seconds=gap):
            yield self.key, self.number, self.first, self.last, self.n
            self.number, self.n = self.number + 1, 0
        if not self.n:
            self.key, self.first = row["key"], at
        self.last, self.n = at, self.n + 1

    def terminate(self):
        if self.n:
            yield self.key, self.number, self.first, self.last, self.n


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL by name."""
    spark.udtf.register("word_windows", udtf(WordWindows))
    spark.udtf.register("sessions", udtf(Sessions))
