"""Change points of signals by binary segmentation, one task per signal.

A segment is split where the drop of the residual sum of squares is greatest,
if it is strictly above the penalty (by default variance times ln n), and both
parts are segmented again.  Values are centred on the segment before they are
summed, so that flat data has no gain at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.errors import ValidationError
from chronoweave.sources.shipping import ship_package


def segment(values: np.ndarray, min_size: int = 2, penalty: float | None = None) -> list[int]:
    """Indices at which a new regime starts, ascending."""
    x = np.asarray(values, dtype=np.float64)
    n = len(x)
    if n < 2 * min_size or n == 0 or np.ptp(x) == 0:
        return []
    limit = float(np.var(x)) * float(np.log(n)) if penalty is None else float(penalty)
    found: list[int] = []
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        size = b - a
        part = x[a:b]
        if size < 2 * min_size or np.ptp(part) == 0:
            continue
        centred = part - part.mean()
        ahead = np.cumsum(centred)[:-1]
        left = np.arange(1, size)
        # With the segment centred, splitting after k values removes s^2/k + s^2/(n-k).
        whole = centred.sum()
        gain = ahead**2 / left + (whole - ahead) ** 2 / (size - left) - whole**2 / size
        usable = slice(min_size - 1, size - min_size)
        gains = gain[usable]
        if not len(gains) or not gains.max() > limit:
            continue
        near = gains >= gains.max() * (1 - 1e-12)
        at = a + int(np.argmax(near)) + min_size
        found.append(at)
        todo += [(a, at), (at, b)]
    return sorted(found)


def changepoints(signals: DataFrame, keys: list[str], min_size: int = 2, penalty: float | None = None) -> DataFrame:
    """(keys..., date): the dates at which a signal changes its level.

    ``signals``: keys, date, value.  NULL and NaN values are dropped; a signal
    shorter than twice ``min_size`` has no change points; NULL keys are keys.
    Signals are hash-partitioned and sorted, and a task works through those of
    its partition one after the other, so that it holds one signal and one
    batch at a time however many there are.
    """
    if isinstance(min_size, bool) or not isinstance(min_size, int) or min_size < 1:
        raise ValidationError("min_size must be a whole number from 1 on")
    ship_package(signals.sparkSession)
    name = F.to_json(F.struct(*keys))
    rows = (
        signals.where("value is not null and not isnan(value)")
        .select(name.alias("__signal"), *keys, "date", "value")
        .repartition("__signal")
        .sortWithinPartitions("__signal", "date")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def cut(table: pa.Table, edges: np.ndarray) -> list[pa.RecordBatch]:
            value = table.column("value").to_numpy()
            at = [a + k for a, b in zip(edges[:-1], edges[1:]) for k in segment(value[a:b], min_size, penalty)]
            return table.select([*keys, "date"]).take(pa.array(at, pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            signal = table.column("__signal").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, signal[1:] != signal[:-1]])
            # The last signal may go on in the next batch.
            rest = table.slice(int(edges[-1])) if len(edges) else None
            if len(edges) > 1:
                yield from cut(table, edges)
        if rest is not None and rest.num_rows:
            yield from cut(rest, np.array([0, rest.num_rows]))

    schema = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{schema}, date date")
