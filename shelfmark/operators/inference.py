"""The slot for model calls: captions, query rewriting, ticket classification, rerank scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import strip

Model = Callable[[Sequence[object]], Sequence[object]]


def call_model(
    df: DataFrame, column: str, make_model: Callable[[], Model], kind: str, *, name: str, batch_size: int = 16
) -> DataFrame:
    """Adds ``name`` of type ``kind`` and ``<name>_error`` from a model.

    ``make_model`` runs once per task. The model gets a list of values and
    returns one result each; an exception in place of a result fails only its
    row. Tasks may be retried, so use idempotent models.
    """
    schema = T.StructType(
        [*df.schema.fields, *T.StructType.fromDDL(f"{name} {kind}, {name}_error string").fields]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            values = batch[column].tolist()
            results: list[object] = []
            for start in range(0, len(values), batch_size):
                part = values[start : start + batch_size]
                found = list(model(part))
                if len(found) != len(part):
                    raise ValueError(f"{len(part)} inputs gave {len(found)} results")
                results.extend(found)
            failed = [isinstance(r, Exception) for r in results]
            yield batch.assign(
                **{
                    name: [None if bad else r for r, bad in zip(results, failed)],
                    f"{name}_error": [str(r) if bad else None for r, bad in zip(results, failed)],
                }
            )

    return df.mapInPandas(run, schema)


def rewritten(original: Column, proposed: Column, has_prior: Column) -> Column:
    """A rewritten query, or the original where it failed, is empty or was not due."""
    usable = F.nullif(strip(proposed), F.lit(""))
    return F.when(has_prior, F.coalesce(usable, original)).otherwise(original)
