"""Text models as Column functions."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)


def text_model(model: Callable[[str, str], str], failed: str | None = None) -> Callable[[Column, Column], Column]:
    """A Column function of (instructions, prompt) from a function of two strings; a null prompt is not asked and gives null.

    A prompt on which the model fails gives `failed`; where that is None the failure ends the job. Marked as not
    deterministic, so that the optimizer never asks twice.
    """

    def one(system: str, prompt: str | None) -> str | None:
        if prompt is None:
            return None
        try:
            return model(system, prompt)
        except Exception as e:
            if failed is None:
                raise
            LOG.warning("a text model failed: %s", e)
            return failed

    @F.pandas_udf("string")
    def run(system: pd.Series, prompt: pd.Series) -> pd.Series:
        return pd.Series([one(s, p) for s, p in zip(system, prompt, strict=True)], dtype=object)

    return run.asNondeterministic()
