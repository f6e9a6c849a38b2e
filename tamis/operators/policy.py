"""Applying decisions on media to the documents that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def applied(media: DataFrame, document: str = "conv_id") -> DataFrame:
    """Status, level and number of flagged media per document, over its media that aren't moderated yet."""
    open_media = media.filter(~F.coalesce("is_moderated", F.lit(False)))
    found = open_media.groupBy(document).agg(F.max("level").alias("level"), F.count("*").alias("media"), F.count_if(F.col("level") > 0).alias("flagged"))
    status = F.when(F.col("level") == 2, "banned").when(F.col("level") == 1, "sensitive").otherwise("active")
    return found.select(document, status.alias("status"), "level", "media", "flagged")
