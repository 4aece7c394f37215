"""A caller's columns and an operator's own, kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Columns of documents that operators read or write; all others are carried.
READ = ("doc_id", "text", "source", "n_chars")


def sheltered(docs: DataFrame) -> DataFrame:
    """`docs` with every column that operators don't read under a name that is no one's, whatever it was called.

    `toDF(*docs.columns)` of a result with the same columns gives the names back.
    """
    return docs.toDF(*(c if c in READ else f"carried_{i}" for i, c in enumerate(docs.columns)))
