"""The gate and the analyser over a stream: both are row-wise, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspan.operators.gate import Category, Theme, analyse, gate


def gated(stream: DataFrame, text: str, categories: list[Category], themes: list[Theme]) -> DataFrame:
    """Works for static and streaming DataFrames alike."""
    return analyse(gate(stream, text, categories), text, themes)
