"""The handle that operators share: cells, long expression and metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Dataset:
    """``cells``: cell_id, sample_id, x, y, cell_type, region; ``expr``: cell_id, gene, raw[, value]."""

    cells: DataFrame
    expr: DataFrame
    meta: dict = field(default_factory=dict)
