"""One pass over the texts: size in tokens of a public tokenizer, position in vector space, quality.

The text is read once and leaves the plan here; everything after works on a few
numbers per document.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronoweave.sources.shipping import ship_package

#: Fixed value: the folder of the public vocabularies on this machine; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMENSIONS = 3
SLOTS = 256
SCHEMA = "doc_id bigint, source string, tokens bigint, x double, y double, z double, quality double"

_ENCODINGS: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a vocabulary file in rank format, built once per process."""
    if path not in _ENCODINGS:
        import tiktoken

        if not os.path.exists(path):
            raise FileNotFoundError(f"no tokenizer vocabulary at {path}; pass its path")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def _directions() -> np.ndarray:
    """Fixed random signs: hash slots by dimensions."""
    k = np.arange(SLOTS * DIMENSIONS, dtype=np.uint64)
    mixed = (k + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).reshape(SLOTS, DIMENSIONS)


def describe(texts: list[str | None], path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, coordinates, quality) of texts; NULL counts as empty.

    Coordinates: token ids hashed into a vector of damped counts, brought to
    length one and projected on fixed random directions.  Quality, above 0 and
    up to 1: variety of tokens times characters per token, low for minified,
    repeated and encoded text.
    """
    tokenizer = encoding(path)
    directions = _directions()
    sizes = np.zeros(len(texts), dtype=np.int64)
    vectors = np.zeros((len(texts), SLOTS))
    quality = np.full(len(texts), 0.05)
    memory: dict[str, int] = {}
    for k, text in enumerate(texts):
        if not text:
            continue
        twin = memory.setdefault(text, k)
        if twin != k:
            sizes[k], vectors[k], quality[k] = sizes[twin], vectors[twin], quality[twin]
            continue
        ids = np.asarray(tokenizer.encode_ordinary(text), dtype=np.int64)
        sizes[k] = len(ids)
        vectors[k] = np.bincount((ids * 2654435761 >> 12) % SLOTS, minlength=SLOTS)
        variety = len(np.unique(ids)) / len(ids)
        quality[k] = np.clip(min(len(text) / len(ids), 5.0) / 5.0 * min(1.0, 0.3 + 2 * variety), 0.05, 1.0)
    vectors = np.log1p(vectors)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return sizes, vectors @ directions, quality


#: Tables with fewer bytes of ids and texts per core than this are moved; the file scan makes few splits of them.
SPLIT_BYTES = 1 << 20


def spread(documents: DataFrame) -> DataFrame:
    """The same rows, over all cores if the table is so small that its scan would keep most of them idle.

    Work on texts is bound by the CPU; a table of a few megabytes may be moved
    for it, a larger one is worked on where it lies.
    """
    cores = documents.sparkSession.sparkContext.defaultParallelism
    size = int(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return documents.repartition(cores) if size < SPLIT_BYTES * cores else documents


def measure(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, x, y, z, quality) per document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                tokens, at, quality = describe(part.column("text").to_pylist(), path)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), pa.array(tokens), *(pa.array(np.ascontiguousarray(at[:, d])) for d in range(DIMENSIONS)), pa.array(quality)],
                    names=["doc_id", "source", "tokens", "x", "y", "z", "quality"],
                )

    ship_package(documents.sparkSession)
    return spread(documents.select("doc_id", "source", "text")).mapInArrow(run, SCHEMA)
