"""Token ids of whole texts with a given, never trained, tokenizer of the tokenizers library.

A text's ids are those of its white-space-separated parts in turn wherever the tokenizer never joins
across white space, which holds for one whose pre-tokenizer drops it (``word_bpe_49k.json``). So each
different part of an Arrow batch is encoded once, and the ids are laid out with numpy.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import rows

#: Texts are worked on in slices of about so many bytes.
SLICE_BYTES = 8 << 20
#: Ids of so many different parts are remembered by a worker; then it keeps those of the slice at hand.
REMEMBERED = 500_000
#: Parts encoded in one call, set apart by spaces.
TOGETHER = 2_000
#: Marks at the end of a part are parts of their own: no token holds a letter or digit and one of them.
_MARKS = r"([A-Za-z0-9])([.,;:!?]+)([ \n\r\t]|$)"

#: Where letters must keep their case for a tokenizer that lowers it: special tokens, and combining marks,
#: which may join a small letter but not its capital.
_CASED = r"<\||[\x{0300}-\x{036F}]"


class Encoder:
    """Encodes Arrow string arrays; one for each Python worker, see ``encoder_of``."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.lowers = "Lowercase" in str(json.loads(self.tokenizer.to_str()).get("normalizer"))
        self.known: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _keep(self, parts: list[str]) -> None:
        """Forget all other parts."""
        kept = [p for p in parts if p in self.known]
        lists = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.pool)).take(pa.array([self.known[p] for p in kept], pa.int64()))
        self.known = dict(zip(kept, range(len(kept))))
        self.pool, self.ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that are not known. A part of letters is one word to a tokenizer that marks word
        ends; else a token belongs to the part in which it starts."""
        letters = [p for p in parts if p.isalpha()]
        parts = letters + [p for p in parts if not p.isalpha()]
        groups = [parts[i : i + TOGETHER] for i in range(0, len(parts), TOGETHER)]
        ids, counts = [self.pool], [np.diff(self.ends)]
        simple = len(letters) // TOGETHER
        joined = [" ".join(g) for g in groups]
        encoded = [*self.tokenizer.encode_batch_fast(joined[:simple], add_special_tokens=False), *self.tokenizer.encode_batch(joined[simple:], add_special_tokens=False)]
        for k, (group, got) in enumerate(zip(groups, encoded)):
            ids.append(np.array(got.ids, np.uint32))
            ends = np.flatnonzero(self.closes[ids[-1]]) + 1
            if k < simple and len(ends) == len(group):
                counts.append(np.diff(ends, prepend=0))
            else:
                offsets = (got if k >= simple else self.tokenizer.encode(joined[k], add_special_tokens=False)).offsets
                stops = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
                begin = np.fromiter((a for a, _ in offsets), np.int64, len(offsets))
                counts.append(np.bincount(np.searchsorted(stops, begin, "right"), minlength=len(group)))
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.pool, self.ends = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def __call__(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids); null is empty; end_id closes each text."""
        texts = pc.fill_null(texts, "")
        if self.lowers and not pc.any(pc.match_substring_regex(texts, _CASED)).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _MARKS, r"\1 \2\3"))
        rows, coded = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        rows = rows - rows[0]
        parts = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._keep(parts)
        self._learn([p for p in parts if p not in self.known])
        which = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        at = which[coded.indices.to_numpy()] if parts else which
        pool, ends = self.pool, self.ends
        if end_id is not None:  # one more part at the end of each row
            at = np.insert(at, rows[1:], len(ends) - 1)
            rows = rows + np.arange(len(rows))
            pool, ends = np.append(pool, np.uint32(end_id)), np.append(ends, ends[-1] + 1)
        laid = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(pool)).take(pa.array(at))
        return laid.flatten().to_numpy(), laid.offsets.to_numpy()[rows]


@lru_cache(maxsize=1)
def encoder_of(tokenizer_path: str) -> Encoder:
    """The worker's encoder: tasks that follow each other in a worker share what it remembers."""
    return Encoder(tokenizer_path)


def forget() -> None:
    """Drop the worker's encoder: steps after the encoding, which reuse its worker, need the memory."""
    encoder_of.cache_clear()
    pa.default_memory_pool().release_unused()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges with about ``most`` bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(texts):
        before = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, before + most, "right")))
        yield i, j
        i = j


def _encode(tokenizer_path: str, end_id: int | None, keep: int, id_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        for batch in batches:
            for i, j in slices(batch.column(keep)):
                cut = batch.slice(i, j - i)
                ids, at = encoder(cut.column(keep), end_id)
                raw = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * id_bytes).astype(np.int32)), pa.py_buffer(narrowed(ids, id_bytes))])
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in range(keep)), pa.array(np.diff(at)), raw], [*(f"k{c}" for c in range(keep)), "n_tokens", "ids"])

    return work


def narrowed(ids: np.ndarray, id_bytes: int) -> np.ndarray:
    if len(ids) and int(ids.max()) >> 8 * id_bytes:
        raise ValueError(f"an id needs more than {id_bytes} bytes")
    return ids.astype(f"<u{id_bytes}")


def encode_texts(documents: DataFrame, tokenizer_path: str, keep: Sequence[str], text: str = "text", end_id: int | None = None, id_bytes: int = 4) -> DataFrame:
    """The columns of ``documents`` named in ``keep``, then ``n_tokens`` (long) and ``ids`` (binary:
    unsigned little-endian numbers of ``id_bytes`` bytes each, 2 or 4).

    Each whole text is encoded without special tokens of the tokenizer's own; a null text counts as
    empty; ``end_id``, if given, follows every text. Rows stay one to one, repeated ones included, and
    other columns are not read. ``keep`` may not hold the two new names.
    """
    schema = rows.schema(documents, keep, "n_tokens long, ids binary")
    narrow = documents.select(*rows.passing(keep), F.col(f"`{text}`").cast("string").alias("text"))
    return narrow.mapInArrow(_encode(tokenizer_path, end_id, len(keep), id_bytes), schema).toDF(*keep, "n_tokens", "ids")
