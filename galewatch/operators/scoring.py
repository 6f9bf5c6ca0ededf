"""Scoring of chips by a model that callers supply, batch by batch, chips built and dropped inside the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galewatch.config import EngineConfig
from galewatch.operators import heatmap
from galewatch.operators.chips import MODEL_KEYS, assembled
from galewatch.operators.quality import sigmoid

#: Chips scored at once: a chip has about 1.8 MB.
BATCH = 16


class Scorer(Protocol):
    def score(self, batch: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Model arrays with a leading batch dimension -> logits [n], heatmaps [n, rows, cols]."""


class ContrastScorer:
    """A deterministic stand-in for tests: not a tornado model. Its heatmap is the local contrast of velocity."""

    def score(self, batch: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v = batch["VEL"][..., 0]
        n, rows, cols = v.shape
        step = np.abs(np.diff(v, axis=1, append=v[:, -1:, :]))
        blocks = step[:, : rows // 8 * 8, : cols // 8 * 8].reshape(n, rows // 8, 8, cols // 8, 8).max(axis=(2, 4))
        return blocks.max(axis=(1, 2)) / 10.0 - 2.0, blocks


def score(parts: DataFrame, make_scorer: Callable[[], Scorer], config: EngineConfig | None = None) -> DataFrame:
    """chip_parts -> the cells with logit, probability and where the heatmap peaks.

    The scorer is made once for each Python worker's task. Heatmaps leave the task as arrays, and built-in functions
    locate their peaks; a heatmap without finite values has none.
    """
    config = config or EngineConfig()
    carried = [f"{n} {t}" for n, t in parts.dtypes if n != "parts"]
    schema = ", ".join([*carried, "logit double", "heatmap array<double>", "rows int", "cols int"])
    names = [c.split()[0] for c in carried]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                rows = batch.iloc[a : a + BATCH]
                chips = [assembled(r.parts, r.range_lower_m, r.range_upper_m, config) for r in rows.itertuples()]
                logits, maps = scorer.score({k: np.stack([c[k] for c in chips]) for k in MODEL_KEYS})
                maps = np.asarray(maps, dtype=np.float64)
                maps = maps.reshape(maps.shape[:3]) if maps.ndim > 3 else maps
                flat = maps.ndim == 3
                out = rows[names].copy()
                out["logit"] = np.asarray(logits, dtype=np.float64).reshape(-1)
                out["heatmap"] = [m.ravel() for m in maps] if flat else None
                out["rows"], out["cols"] = (maps.shape[1], maps.shape[2]) if flat else (None, None)
                yield out

    scored = parts.mapInPandas(run, schema).withColumn("probability", sigmoid(F.col("logit")))
    at = heatmap.argmax(F.transform("heatmap", lambda x: F.when(F.abs(x) < float("inf"), x)))
    scored = scored.withColumn("_at", at).withColumn("heatmap_row", F.floor(F.col("_at") / F.col("cols")).cast("int")).withColumn("heatmap_col", (F.col("_at") % F.col("cols")).cast("int"))
    r, c = (F.col("heatmap_row") + 0.5) / F.col("rows"), (F.col("heatmap_col") + 0.5) / F.col("cols")
    margin = F.when(F.col("_at").isNotNull(), F.least(r, 1.0 - r, c, 1.0 - c))
    az = F.pmod(F.col("az_lower") + r * (F.col("az_upper") - F.col("az_lower")), F.lit(360.0))
    km = (F.col("range_lower_m") + c * (F.col("range_upper_m") - F.col("range_lower_m"))) / 1000.0
    return scored.withColumn("edge_margin", margin).withColumn("activation_az_deg", az).withColumn("activation_range_km", km).drop("_at", "heatmap")
