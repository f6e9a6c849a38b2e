"""The one place where a model meets the data: a batch scorer behind mapInPandas.

Filters belong before the call, for Spark moves none below it. The model is loaded once per task, not per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], np.ndarray]


def scored(rows: DataFrame, load: Callable[[], Scorer], name: str = "score", batch_rows: int | None = None) -> DataFrame:
    """`rows` with a column of what the loaded scorer gives for each batch, of batch_rows rows at most if that is set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            step = batch_rows or max(1, len(batch))
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                yield part.assign(**{name: np.asarray(scorer(part), np.float64)})

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != name)
    return rows.mapInPandas(run, f"{fields}, `{name}` double")


#: Images go to the scorer so many at a time, videos one by one.
IMAGE_BATCH, VIDEO_BATCH = 64, 1


def scored_media(media: DataFrame, load_images: Callable[[], Scorer], load_videos: Callable[[], Scorer]) -> DataFrame:
    """Images and videos with their scores, each kind by its own scorer in batches of its own size; other media are left
    out. Tasks hold a batch, whatever the input's size."""
    kind = lambda k: media.filter(F.startswith("mime", F.lit(f"{k}/")))
    images, videos = scored(kind("image"), load_images, batch_rows=IMAGE_BATCH), scored(kind("video"), load_videos, batch_rows=VIDEO_BATCH)
    return images.unionByName(videos)


def effective_rank(rows: DataFrame, group: str, vector: str, share: float = 0.01) -> DataFrame:
    """Singular values above a share of the largest, per group, from the group's second-moment matrix.

    Each task adds up its own matrix; the rows of the matrix, not whole matrices, are then added up apart from each
    other, so a group of any size is spread over as many keys as there are dimensions.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for key, part in batch.groupby(group):
                x = np.stack(part[vector].to_numpy()).astype(float)
                sums[key] = sums.get(key, 0) + x.T @ x
        for key, m in sums.items():
            yield pd.DataFrame({group: key, "i": range(len(m)), "m": list(m)})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [part[group].iloc[0]], "i": [part["i"].iloc[0]], "m": [np.sum(np.stack(part["m"].to_numpy()), axis=0)]})

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(np.stack(part.sort_values("i")["m"].to_numpy())), 0))
        return pd.DataFrame({group: [part[group].iloc[0]], "rank": [int((s > share * s.max()).sum())]})

    kind = dict(rows.dtypes)[group]
    cells = f"{group} {kind}, i int, m array<double>"
    partial = rows.select(group, vector).mapInPandas(moments, cells)
    return partial.groupBy(group, "i").applyInPandas(added, cells).groupBy(group).applyInPandas(rank, f"{group} {kind}, rank int")
