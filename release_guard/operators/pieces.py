"""Running values over ordered groups of any size, in equal pieces.

A window over a group runs in one task, however large the group is. Here the rows are cut into ranges of (key, order) of
about equal size, each range is gone through once, and what a range leaves to the next is worked out on two rows
per range. So one key with all rows spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package, stored


def running(
    df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str] = (), number: str = "n"
) -> DataFrame:
    """Replace ``values`` by their last non-null value so far within the key, and add the row's number in it, from 1.

    Rows are ordered by ``order``, ascending and nulls first; rows equal in it must be equal in what matters. A null
    key is a key. The pieces are written once to the shared scratch folder.
    """
    names = [f.name for f in df.schema.fields]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    extra = {number: "long", "piece": "int", "head": "boolean", "mark": "string"}
    schema = ", ".join(f"`{n}` {k}" for n, k in {**kinds, **extra}.items())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        last_key: tuple | None = None
        carried: dict[str, pa.Array] = {}
        seen, head, template = 0, True, None

        def mark(kind: str, row_key: tuple, held: dict[str, pa.Array], count: int | None) -> pa.RecordBatch:
            cells = []
            for field in template:
                own = pa.array([row_key[key.index(field.name)]], field.type) if field.name in key else pa.nulls(1, field.type)
                cells.append(held.get(field.name, own))
            tail = [pa.array([count], pa.int64()), pa.array([piece], pa.int32()), pa.array([None], pa.bool_()), pa.array([kind])]
            return pa.RecordBatch.from_arrays([*cells, *tail], names=[*names, *extra])

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            template = batch.schema
            change = np.zeros(size, bool)
            for name in key:
                codes = batch.column(name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(name)[0].as_py() for name in key)
            if last_key is None:
                yield mark("first", first, {}, None)
            goes_on = last_key is not None and first == last_key
            if not goes_on:
                head = head and last_key is None
                carried, seen = {name: pa.nulls(1, batch.column(name).type) for name in values}, 0
            rows = np.arange(size)
            start = np.maximum.accumulate(np.where(change, rows, 0))
            replaced = {}
            for name in values:
                column = batch.column(name)
                latest = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), rows, -1))
                # Row 0 of what is taken from is the value carried into the batch, for rows of its first run.
                at = np.where(latest >= start, latest + 1, 0)
                nothing = (latest < start) & (start > 0)
                source = pa.concat_arrays([carried[name], column])
                replaced[name] = source.take(pa.array(at, mask=nothing))
                carried[name] = replaced[name].slice(size - 1, 1)
            numbers = rows - start + 1 + np.where(start == 0, seen, 0)
            seen = int(numbers[-1])
            heads = (start == 0) & head
            head = bool(heads[-1])
            last_key = tuple(batch.column(name)[size - 1].as_py() for name in key)
            columns = [replaced.get(n, batch.column(n)) for n in names]
            columns += [pa.array(numbers, pa.int64()), pa.array([piece] * size, pa.int32()), pa.array(heads), pa.nulls(size, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *extra])
        if last_key is not None:
            yield mark("last", last_key, carried, seen)

    ship_package(df.sparkSession)
    placed = df.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    gone = stored(placed.mapInArrow(go, schema), "pieces")
    earlier = Window.partitionBy(*key).orderBy("piece", "mark").rowsBetween(Window.unboundedPreceding, -1)
    carry = gone.where("mark is not null").select(
        "piece",
        "mark",
        F.coalesce(F.sum(number).over(earlier), F.lit(0)).alias("rows before"),
        *[F.last(v, ignorenulls=True).over(earlier).alias(f"{v} before") for v in values],
    )
    carry = carry.where("mark = 'first'").drop("mark")
    rows = gone.where("mark is null").join(carry, "piece")
    return rows.select(
        *[
            F.coalesce(F.col(f"`{n}`"), F.when(F.col("head"), F.col(f"`{n} before`"))).alias(n) if n in values else F.col(f"`{n}`")
            for n in names
        ],
        (F.col(number) + F.when(F.col("head"), F.col("`rows before`")).otherwise(0)).alias(number),
    )
