"""Hooks for functions that need a model. A loader is called once a worker; without one the fallbacks below stand."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, StringType

_LOADED: dict[str, Callable] = {}


def model_function(name: str, loader: Callable[[], Callable[[list], list]], kind: DataType) -> Callable[[Column], Column]:
    """A vectorised function over batches; the model stays in the worker's process."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        if name not in _LOADED:
            _LOADED[name] = loader()
        return pd.Series(_LOADED[name](values.tolist()))

    return run


def embedder(loader: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    return model_function("embedding", loader, ArrayType(FloatType()))


def text_of_images(loader: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    return model_function("ocr", loader, StringType())


def caption_of_images(loader: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    return model_function("caption", loader, StringType())


def fallback_caption(at: Column) -> Column:
    return F.concat(F.lit("Screenshot captured at "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def equalized(image):
    """Grey levels spread by their cumulative histogram."""
    import numpy as np

    counts = np.bincount(image.ravel(), minlength=256)
    total = np.cumsum(counts)
    low = total[np.flatnonzero(counts)[0]]
    span = max(image.size - low, 1)
    return np.clip(np.round((total - low) * 255.0 / span), 0, 255).astype(np.uint8)[image]


def otsu_threshold(image) -> int:
    """The grey level with the largest variance between the classes it parts."""
    import numpy as np

    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    levels = np.arange(256)
    below = np.cumsum(counts)
    above = image.size - below
    with np.errstate(invalid="ignore", divide="ignore"):
        low = np.cumsum(counts * levels) / below
        high = ((counts * levels).sum() - np.cumsum(counts * levels)) / above
        between = np.nan_to_num(below * above * (low - high) ** 2)
    return int(between.argmax())


def binarized(image):
    return (image > otsu_threshold(image)) * 255
