"""Compositions of operators that mirror the reference's end-to-end steps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from sigfolio.operators import clean as C
from sigfolio.operators import training as TR
from sigfolio.operators.messages import COLUMN_MAP, TRUE_CATEGORY


def training_set(df: DataFrame, column_map: Mapping[str, str] = COLUMN_MAP, unique: bool = True,
                 sample: int = 0, threshold: int = 0, seed: int = 42, label: str = TRUE_CATEGORY) -> DataFrame:
    """Blank and lower-case cells -> normalise names -> map columns -> drop
    blank labels -> dedupe -> exact seeded sample -> class threshold."""
    df = C.lower_cells(C.fill_blank(df, ""))
    df = C.map_columns(C.normalize_columns(df), column_map)
    df = C.drop_blank_label(df, label)
    if unique:
        df = df.dropDuplicates()
    if sample:
        df = TR.sample_n(df, sample, df.columns, seed)
    if threshold:
        df = TR.class_threshold(df, label, threshold)
    return df
