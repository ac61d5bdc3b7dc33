"""Question/answer records with nested answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_qa(records: DataFrame, id_column: str = "qa_id") -> DataFrame:
    """`(qa_id, context, question, answer)`: first answer or the empty string."""
    first = F.coalesce(F.get(F.col("answers.text"), F.lit(0)), F.lit(""))
    return records.select(F.col(id_column).alias("qa_id"), "context", "question",
                          first.alias("answer"))
