"""From a raw corpus to stored texts, labels and embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.text import as_corpus
from ..operators.sampling import sample_rows
from ..sources.artifacts import ArtifactStore, parity
from ..sources.corpora import keyed


def prepare_dataset(store: ArtifactStore, dataset: str, encoder: str, load: Callable[[], DataFrame],
                    encode: Callable[[DataFrame], DataFrame], max_samples: int | None = None,
                    strategy: str = "stratified", seed: int = 42) -> bool:
    """Clean, sample, store and encode a corpus. False if its embeddings are stored already.

    `load` returns a raw table (text and label by name or position); without a row_id it gets one.
    """
    if max_samples is not None and max_samples < 1:
        raise ValueError("max_samples must be positive")
    if strategy not in ("stratified", "head"):
        raise ValueError(f"unknown sampling strategy: {strategy}")
    key = store.key(dataset, max_samples, strategy, seed)
    if store.has_embeddings(key, encoder):
        return False
    if not store.has_corpus(key):
        raw = load()
        corpus = as_corpus(raw if "row_id" in raw.columns else keyed(raw), "row_id")
        if max_samples is not None:
            extra = {"seed": seed} if strategy == "stratified" else {}
            corpus = sample_rows(corpus, max_samples, strategy, **extra)
        store.write_corpus(corpus, key)
        store.complete(key)
    corpus = store.corpus(key)
    store.write_embeddings(encode(corpus), key, encoder)
    missing = parity(corpus, store.embeddings(key, encoder)).first()
    if any(missing):
        raise ValueError(f"texts and embeddings of {dataset} do not match: {missing.asDict()}")
    store.complete(key, encoder)
    return True

