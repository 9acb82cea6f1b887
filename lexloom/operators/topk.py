"""Best rows of each query."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rounded(score: np.ndarray, places: int = 6) -> np.ndarray:
    """Rounded once, halves away from zero, as SQL rounds."""
    return np.trunc(score * 10.0**places + np.copysign(0.5, score)) / 10.0**places


def top_k(hits: DataFrame, k: int, query: str = "query_id", item: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best rows of each query by the score rounded to six places, ties by item; adds rank."""
    ranked = hits.withColumn(score, F.round(score, 6))
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
