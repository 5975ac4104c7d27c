"""Filling containers of fixed capacity with texts that lie near each other.

Documents get a position in a few dimensions (hashed vector, projected) and
from it a key on a Hilbert curve, so that neighbours on the curve are similar.
They are range-sorted by that key, and every range is packed along the curve:
a *window* of neighbours at a time is placed best-fit, largest first, into the
containers that are open; containers that are as good as full are closed and
the others stay open for the next window.  A text is cut only if it alone
exceeds the capacity: into full containers and one remainder.

A window is bounded in tokens along the curve, not in containers: the larger
the capacity, the fewer containers it holds, so that their documents stay
neighbours.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.measure import TOKENIZER, measure
from chronoweave.sources.scratch import materialize

BITS = 10
AXES = ("x", "y", "z")


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on a Hilbert curve of integer points (rows), each coordinate below 2**bits.

    Coordinates are brought to the curve's transposed form by undoing its
    reflections and exchanges from the top bit down, all points at once; the
    bits are then interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for d in range(dims):
            upper = (x[d] & level) != 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(upper, below, swap)
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def curve_keys(measured: DataFrame) -> DataFrame:
    """Adds ``curve``: coordinates, centred and scaled over all documents, on the Hilbert curve."""
    stats = measured.agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("mean", F.avg), ("std", F.stddev_pop)))).first()
    means = np.array([stats[f"mean_{a}"] or 0.0 for a in AXES])
    stds = np.array([stats[f"std_{a}"] or 1.0 for a in AXES])

    @F.pandas_udf("bigint")
    def curve(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        at = (np.stack([x, y, z], axis=1) - means) / stds
        cell = (1 << BITS) / (1 + np.exp(-1.7 * at))
        return pd.Series(hilbert_key(np.clip(cell, 0, (1 << BITS) - 1).astype(np.int64)))

    return measured.withColumn("curve", curve("x", "y", "z"))


def fill(items: Iterable[tuple[int, int]], capacity: int, window_tokens: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(container, item, piece, first token, tokens) for (item, tokens) in curve order.

    Items without tokens take no container and are not yielded here.
    """
    open_spaces: list[tuple[int, int]] = []  # (space left, container), sorted
    made = 0
    window: list[tuple[int, int, int, int]] = []  # tokens, doc_id, piece, first token
    held = 0
    shut = max(1, capacity // 64)

    def place() -> Iterator[tuple[int, int, int, int, int]]:
        nonlocal made, open_spaces
        for tokens, doc, piece, first in sorted(window, key=lambda w: (-w[0], w[1], w[2])):
            at = bisect_left(open_spaces, (tokens, -1))
            if at < len(open_spaces):
                space, container = open_spaces.pop(at)
            else:
                space, container, made = capacity, made, made + 1
            if space > tokens:
                insort(open_spaces, (space - tokens, container))
            yield container, doc, piece, first, tokens
        open_spaces = [s for s in open_spaces if s[0] >= shut]
        window.clear()

    for doc, tokens in items:
        first = piece = 0
        while tokens - first > capacity:
            yield made, doc, piece, first, capacity
            made, first, piece = made + 1, first + capacity, piece + 1
        if tokens > first:
            window.append((tokens - first, doc, piece, first))
            held += tokens - first
        if held >= window_tokens:
            yield from place()
            held = 0
    yield from place()


def pack(documents: DataFrame, sizes: DataFrame, tokenizer: str = TOKENIZER, **how) -> DataFrame:
    """(pack_name, container_id, doc_id, piece, token_from, n_tokens); see ``pack_measured``.

    The texts are measured once and the measures written, for all capacities.
    """
    measured = materialize(measure(documents, tokenizer).select("doc_id", "tokens", "x", "y", "z"), "pack-sizes")
    return pack_measured(measured, sizes, **how)


def pack_measured(measured: DataFrame, sizes: DataFrame, window_tokens: int = 262_144, task_tokens: int = 20_000_000, at_once: int = 64, positions: bool = False) -> DataFrame:
    """(pack_name, container_id, doc_id, piece, token_from, n_tokens) of measured documents (``measure``), stored by the caller.

    ``sizes``: pack_name, capacity_tokens, of which rows without name or with
    no positive capacity are ignored and equal ones count once.  Capacities are
    taken ``at_once`` in one pass over the measures, so any number of them can
    be asked for.  A window has ``window_tokens``, or eight containers if that
    is more.  Documents without tokens (NULL or empty text) occupy nothing: one
    row each and pack with a NULL container.  Repeated rows are packed as often
    as they come, rows with a NULL doc_id too.  Container ids are unique within
    a pack.  ``positions`` adds the coordinates x, y, z.
    """
    total = measured.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(1, -(-total // task_tokens))
    along = (
        curve_keys(measured)
        .select("curve", "doc_id", "tokens", *(AXES if positions else ()))
        .repartitionByRange(ranges, "curve", "doc_id")
        .sortWithinPartitions("curve", "doc_id", "tokens")
    )
    wanted = sizes.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("bigint")).distinct()
    names = "pack_name string, container_id bigint, doc_id bigint, piece int, token_from bigint, n_tokens bigint" + (", x double, y double, z double" if positions else "")
    rows = map(tuple, wanted.toLocalIterator())
    passes = [along.mapInArrow(_packer(some, window_tokens, positions), names) for some in iter(lambda: list(islice(rows, at_once)), [])]
    return reduce(DataFrame.unionByName, passes) if passes else along.limit(0).mapInArrow(_packer([], window_tokens, positions), names)


def _packer(packs: list[tuple[str, int]], window_tokens: int, positions: bool):
    """What one task does with its range of the curve: every capacity, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("doc_id"), b.column("tokens").to_numpy(zero_copy_only=False), *(b.column(a) for a in (AXES if positions else ()))) for b in batches]
        if not parts:
            return
        docs, tokens, *at = (pa.chunked_array([p[k] for p in parts]) if k != 1 else np.concatenate([p[1] for p in parts]) for k in range(len(parts[0])))
        tokens = np.nan_to_num(tokens).astype(np.int64)
        high = TaskContext.get().partitionId() << 40
        for name, capacity in packs:
            rows: list[tuple] = [(None, k, 0, 0, 0) for k in np.flatnonzero(tokens == 0).tolist()]
            for container, *rest in fill(enumerate(tokens.tolist()), capacity, max(window_tokens, 8 * capacity)):
                rows.append((high | container, *rest))
                if len(rows) >= 50_000:
                    yield _batch(name, rows, docs, at)
                    rows = []
            if rows:
                yield _batch(name, rows, docs, at)

    return run


def _batch(name: str, rows: list[tuple], docs: pa.ChunkedArray, at: list[pa.ChunkedArray]) -> pa.RecordBatch:
    container, item, piece, first, tokens = zip(*rows)
    which = pa.array(item, pa.int64())
    take = lambda column: column.take(which).combine_chunks()
    columns = [pa.array([name] * len(rows), pa.string()), pa.array(container, pa.int64()), take(docs), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(tokens, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *map(take, at)], names=["pack_name", "container_id", "doc_id", "piece", "token_from", "n_tokens", *AXES[: len(at)]])


def fill_report(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, share of the space that is used, documents cut, and locality.

    ``packed`` has positions.  ``locality`` is 1 minus the spread of positions
    within containers over their spread in all, so 1 if the texts of a container
    are alike and near 0 if they are thrown together.  The sums are made per
    container first, with map-side combining.
    """
    n = F.count(F.lit(1))
    per = packed.where("container_id is not null").groupBy("pack_name", "container_id").agg(
        n.alias("n"), F.sum("n_tokens").alias("tokens"), F.count_if((F.col("piece") == 1)).alias("cut"),
        *(F.sum(a).alias(a) for a in AXES), sum((F.sum(F.col(a) * F.col(a)) for a in AXES), F.lit(0.0)).alias("squares"),
    )
    inner = F.col("squares") - sum((F.col(a) * F.col(a) for a in AXES), F.lit(0.0)) / F.col("n")
    whole = F.sum("squares") - sum((F.sum(a) * F.sum(a) for a in AXES), F.lit(0.0)) / F.sum("n")
    report = per.groupBy("pack_name").agg(
        n.alias("containers"), F.sum("tokens").alias("tokens"), F.sum("cut").alias("documents_cut"),
        (1 - F.try_divide(F.sum(inner), whole)).alias("locality"),
    )
    return report.join(sizes.select("pack_name", "capacity_tokens").distinct(), "pack_name").withColumn(
        "filled", F.try_divide(F.col("tokens"), F.col("containers") * F.col("capacity_tokens"))
    )
