"""Models that follow a stream of labelled samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.models import Classifier, refit
from ..sources.store import Store


def updating(store: Store, name: str, model: Classifier, *, batches: int | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that fits the model again on the samples kept so far, and saves it as ``name``.

    MLlib's trees can't be fitted further, so samples are kept: those of a batch in
    a folder of its number, which a batch that comes again replaces.  With
    ``batches`` only the last so many count.  A batch without samples changes
    nothing.  The model of the last batch is what ``store.load(name)`` gives.
    """
    path = f"{store.root}/samples/{name}"

    def update(rows: DataFrame, number: int) -> None:
        if rows.isEmpty():
            return
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept = rows.sparkSession.read.parquet(path)
        if batches is not None:
            kept = kept.filter(kept["batch"] > number - batches)
        store.save(refit(model, kept.drop("batch")), name, {"batch": number, "n_samples": kept.count()})

    return update
