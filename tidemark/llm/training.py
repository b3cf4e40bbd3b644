"""Models fitted on bounded samples of labelled documents."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def fitted(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, fit: Callable[[pd.DataFrame, dict[int, int]], Any], *, key: str = "doc_id", text: str = "text") -> Any:
    """fit(sample, counts) in one task, so that neither texts nor training take the driver's memory: the driver gets the model.

    The sample is (id, text, y) of at most per_class documents of each label, picked by a hash of the id; learn
    says which ids may be learned from. Null labels, ids and texts are not learned from; if an id has several labels or
    texts, the smallest counts, so the sample is bounded however often ids repeat. counts are the labelled ids of each kind, so that a model can keep their true proportion.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learn).groupBy(key).agg(F.min(label).alias("y"))
    picked = None
    for value in (0, 1):
        part = y.where(F.col("y") == value).orderBy(F.xxhash64(key), key).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(key), F.col(text).alias("text")).where("text is not null").join(F.broadcast(picked), key).groupBy(key).agg(F.min("text").alias("text"), F.min("y").alias("y"))
    counts = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            sample = pd.concat(held).sort_values(["id", "text"]).reset_index(drop=True)
            yield pd.DataFrame({"model": [pickle.dumps(fit(sample, counts))]})

    made = rows.select(F.col(key).alias("id"), "text", "y").repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(bytes(made[0]["model"])) if made else fit(pd.DataFrame({"id": [], "text": [], "y": []}), counts)
