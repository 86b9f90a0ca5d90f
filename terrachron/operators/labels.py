"""Label layout: a greedy choice by priority inside each collision group of each view."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def _place(padding: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        free = ~(rows["selected"] | rows["pinned"])
        order = rows.assign(_free=free).sort_values(["_free", "priority", "key"], ascending=[True, False, True], kind="stable")
        boxes = order[["left", "top", "right", "bottom"]].to_numpy(float)
        kept: list[int] = []
        for i, box in enumerate(boxes):
            if order["_free"].iat[i] and kept:
                placed = boxes[kept]
                hit = (box[0] < placed[:, 2] + padding) & (placed[:, 0] < box[2] + padding) & (box[1] < placed[:, 3] + padding) & (placed[:, 1] < box[3] + padding)
                if np.any(hit):
                    continue
            kept.append(i)
        return order.iloc[kept].drop(columns="_free")

    return run


def layout(labels: DataFrame, padding: float = 3.0, most: int | None = None) -> DataFrame:
    """The labels (view, collision_group, key, priority, selected, pinned, left, top, right, bottom) that are shown.

    Selected and pinned labels always are. `most` is a limit of candidates by priority for a group of one view, for
    screens that ask for it; they are ranked in Spark, so no more are gathered. A group of one view is one task's work,
    as each choice depends on those before; the views are what is spread.
    """
    if most is not None:
        w = Window.partitionBy("view", "collision_group").orderBy(~(F.col("selected") | F.col("pinned")), F.desc("priority"), "key")
        labels = labels.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")
    return labels.groupBy("view", "collision_group").applyInPandas(_place(padding), labels.schema)
