"""tarn: hybrid document retrieval and retrieval evaluation as Spark DataFrame plans."""

from importlib import import_module

__version__ = "0.2.0"

#: Where the exported names live; they are imported when they are asked for, not in every task.
_HOMES = {
    "tarn.operators.bm25": ("EmptyCorpus", "IndexMismatch", "IndexMissing"),
    "tarn.operators.chunking": ("ChunkLimits",),
    "tarn.operators.rewrite": ("BadAliases",),
    "tarn.plans.embedding": ("http_embedder", "http_scorer"),
    "tarn.plans.engine": ("Answer", "Engine"),
    "tarn.plans.settings": ("Settings",),
    "tarn.sources.pointers": ("ConcurrentChange",),
    "tarn.sources.requests": ("RequestConflict", "RequestRunning"),
}
__all__ = sorted(name for names in _HOMES.values() for name in names)


def __getattr__(name: str):
    home = next((module for module, names in _HOMES.items() if name in names), None)
    if home is None:
        raise AttributeError(f"tarn has no {name}")
    return getattr(import_module(home), name)
