"""Caller-supplied batch scoring inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

BATCH = 32


def score_batches(
    rows: DataFrame, ident: str, item: str, predict: Callable[[list], list[tuple[str, float]]], batch: int = BATCH
) -> DataFrame:
    """Label and confidence per row from ``predict(list) -> list`` over small batches.

    Missing or empty items are ``unavailable`` and never reach ``predict``; a result of
    another length than its batch is an error.
    """

    def run(frames):
        for pdf in frames:
            usable = pdf[item].notna() & (pdf[item] != "")
            labels = pd.Series("unavailable", index=pdf.index, dtype=object)
            scores = pd.Series(float("nan"), index=pdf.index)
            index = pdf.index[usable]
            for at in range(0, len(index), batch):
                part = index[at : at + batch]
                got = predict(list(pdf.loc[part, item]))
                if len(got) != len(part):
                    raise ValueError(f"predict returned {len(got)} results for {len(part)} items")
                labels.loc[part] = [g[0] for g in got]
                scores.loc[part] = [float(g[1]) for g in got]
            yield pd.DataFrame({ident: pdf[ident], "label": labels, "confidence": scores.astype(object).where(usable, None)})

    kind = dict(rows.dtypes)[ident]
    return rows.select(ident, item).mapInPandas(run, f"{ident} {kind}, label string, confidence double")
