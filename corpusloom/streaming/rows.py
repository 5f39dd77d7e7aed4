"""Row-local operators on streams: they keep no state, so the batch expressions hold unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, prepare


def judged(stream: DataFrame) -> DataFrame:
    """Pairs with the reason for which a batch run would remove them (null: valid). Ids need the whole table, so a
    stream gets none."""
    return stream.withColumn("removal_reason", prepare.removal_reason(F.col("ESP"), F.col("SHIWILU")))


def normalized(stream: DataFrame, rules: list[str] | dict | None = None) -> tuple[DataFrame, DataFrame]:
    return prepare.normalize(stream, rules)


def suspicious(stream: DataFrame) -> DataFrame:
    return audit.suspicious_content(stream)
