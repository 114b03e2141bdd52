"""Settings of the engine, with their bounds."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from tarn.operators.chunking import ChunkLimits


@dataclass(frozen=True)
class Settings:
    """Names and defaults of this block are fixed values, as users of the service know them."""

    root: str
    embedding_model: str = "hashed-terms"
    embedding_dimensions: int = 1024
    dense_top_k: int = 30
    bm25_top_k: int = 30
    rrf_constant: int = 60
    rerank_top_k: int = 20
    final_top_k: int = 5
    low_confidence_threshold: float = -4.0
    chunk_target: int = 1400
    chunk_maximum: int = 2200
    chunk_overlap: int = 200
    #: Lists of the approximate index and how many are probed; 0: by the size of the corpus.
    nprobe: int = 0
    lists: int = 0
    #: Parts of the tables, by a hash of the document; an ingestion rewrites those that it touches. Fixed once
    #: there are tables.
    buckets: int = 64
    #: Services; without an address the stand-ins that need no model are used.
    embedding_url: str = ""
    embedding_batch_size: int = 32
    rerank_url: str = ""
    rerank_model: str = ""
    #: The environment variable that holds the services' key: keys are no settings, so they are never shown.
    key_variable: str = "TARN_SERVICE_KEY"
    timeout_seconds: float = 60.0
    #: A JSON file of aliases in place of the dictionary that ships with the engine.
    alias_path: str = ""
    #: "module:function" that cuts a run of Han characters into words, or "lexicon": the dictionary that the
    #: engine builds from its own chunks.
    segmenter: str = ""

    def __post_init__(self):
        if not self.root.strip() or not self.embedding_model.strip():
            raise ValueError("root and embedding_model must not be blank")
        for name in ("embedding_dimensions", "dense_top_k", "bm25_top_k", "rrf_constant", "rerank_top_k", "final_top_k", "embedding_batch_size", "timeout_seconds", "buckets"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.nprobe < 0 or self.lists < 0:
            raise ValueError("nprobe and lists must not be negative")
        if self.rerank_top_k < self.final_top_k:
            raise ValueError(f"{self.final_top_k} final results cannot come from {self.rerank_top_k} reranked ones")
        if self.segmenter and ":" not in self.segmenter and self.segmenter != "lexicon":
            raise ValueError("segmenter must be lexicon or name module:function")
        self.limits  # noqa: B018  checks them

    @property
    def limits(self) -> ChunkLimits:
        return ChunkLimits(self.chunk_target, self.chunk_maximum, self.chunk_overlap)

    @classmethod
    def from_environment(cls, prefix: str = "TARN_", **given) -> Settings:
        """Settings named TARN_ROOT, TARN_DENSE_TOP_K and so on; what is given goes first."""
        of = {"int": int, "float": float, "str": str}
        found = {f.name: of[f.type](os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ}
        return cls(**found | given)
