"""Running sums and ranks over groups of any size.

A window over a group has one task sort all of it. Here rows are dealt into ranges of group and order
first, so a large group lies in several ranges, and a sum comes from two levels: of the ranges before,
of which there are few, and of the rows before within the range. The ranges are written once, as their
bounds come from a sample that another run may draw otherwise.

Columns of a group hold no nulls. Rows that agree in the order lie in one range; ranks() and numbers()
tell them apart by chance, so equal rows do not gather either. Both move and write the rows once and
join only what is told of the ranges; ranks() looks up where the first of rows that agree lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.sources.work import written


def sums_before(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the group that come before, 0 for the first. The order
    has to tell the rows of a group apart; a null value adds nothing."""
    dealt = written(rows.withColumn("__value", F.coalesce(value, F.lit(0))).repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    key, earlier = [*group, "__range"], (Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*key).agg(F.sum("__value").alias("__total"))
    ahead = totals.select(*key, F.coalesce(F.sum("__total").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(*earlier)), F.lit(0)).alias("__ahead"))
    own = F.coalesce(F.sum("__value").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    return dealt.withColumn("__own", own).join(ahead, key).select(*rows.columns, (F.col("__ahead") + F.col("__own")).alias(name))


def placed(group: list[str], by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a range in order: adds __start, the place among its group's rows, from 0, of the first that
    agrees with a row; of a group's first and last row __edge, its place, and of the last __last. Only these
    two keep what they are ordered by. Executors need no module of ours for it."""

    def changes(column: pa.Array, before: pa.Array | None) -> np.ndarray:
        """Whether each value differs from the one before; nulls agree, and so do values that are no number."""
        whole = pa.concat_arrays([column.slice(0, 1) if before is None else before, column])
        a, b = whole.slice(0, len(column)), whole.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
        if pa.types.is_floating(column.type):
            same = pc.and_(same, pc.equal(pc.is_nan(a).fill_null(False), pc.is_nan(b).fill_null(False)))
        return ~same.to_numpy(zero_copy_only=False)

    def finished(batch: pa.RecordBatch, start: np.ndarray, place: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        edge = pa.array((place == 0) | last)
        held = [pc.if_else(edge, c, pa.scalar(None, c.type)) if name in by else c for name, c in zip(batch.schema.names, batch.columns)]
        return pa.RecordBatch.from_arrays([*held, pa.array(start), pc.if_else(edge, pa.array(place), pa.scalar(None, pa.int64())), pa.array(last)], names=[*batch.schema.names, "__start", "__edge", "__last"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # a batch goes out when the next tells whether its last row is its group's
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {}
            for kind, names in (("group", group), ("key", by)):
                new[kind] = np.zeros(batch.num_rows, bool)
                for name in names:
                    new[kind] |= changes(batch.column(name), waiting and waiting[0].column(name).slice(waiting[0].num_rows - 1))
            new["group"][0] |= waiting is None
            at = np.arange(batch.num_rows)
            since = {k: np.maximum.accumulate(np.where(v, at, -1)) for k, v in (("group", new["group"]), ("key", new["group"] | new["key"]))}
            place = np.where(since["group"] < 0, at + (waiting[2][-1] + 1 if waiting else 0), at - since["group"])
            start = np.where(since["key"] < 0, waiting[1][-1] if waiting else 0, place[since["key"]])
            if waiting:
                waiting[3][-1] = new["group"][0]
                yield finished(*waiting)
            waiting = batch, start, place, np.append(new["group"][1:], False)
        if waiting:
            waiting[3][-1] = True
            yield finished(*waiting)

    return read


def ranks(rows: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds each row's rank in its group, from 1; rows that agree in the order share one. Nulls come
    first, as they do in an ascending sort. Rows that agree may lie in several ranges, that of the first
    of which tells their rank."""
    by = {f"__o{i}": F.col(x) if isinstance(x, str) else x for i, x in enumerate(order)}
    key = [*group, "__range"]
    sorted_rows = rows.withColumns(by).repartitionByRange(*group, *by, F.rand(1)).sortWithinPartitions(*group, *by).withColumn("__range", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema)
    dealt = written(sorted_rows.mapInArrow(placed(group, list(by)), f"{schema}, __start long, __edge long, __last boolean"), "ranges")
    edges, same = dealt.where("__edge IS NOT NULL"), F.struct(*by)
    tails = edges.where("__last").select(*key, same.alias("tail"), "__start", (F.col("__edge") + 1).alias("n"))
    spans = edges.where("__edge = 0").select(*key, same.alias("head")).join(tails, key)
    along = Window.partitionBy(*group).orderBy("__range")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"__ahead": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "__on": F.col("head").eqNullSafe(F.lag("tail").over(along))})
    # where the rows that agree with a range's last begin, unless that is the range before's to tell
    spans = spans.withColumn("__tail", F.when(~F.col("__on") | (F.col("__start") > 0), F.col("__ahead") + F.col("__start")))
    spans = spans.select(*key, "__ahead", F.when(F.col("__on"), F.last("__tail", ignorenulls=True).over(earlier)).otherwise(F.col("__ahead")).alias("__first"))
    # written, so Spark knows how small they are; as an outer join, whose left side it never broadcasts
    before = F.when(F.col("__start") == 0, F.col("__first")).otherwise(F.col("__ahead") + F.col("__start"))
    return dealt.join(written(spans, "spans"), key, "left").select(*rows.columns, (before + 1).alias(name))


def numbers(rows: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds each row's number in its group, from 1 without gaps; rows that agree in the order get theirs
    in any way. Nulls come first. Rows are moved and written once, and nothing is joined but the counts
    of the ranges."""
    by = {f"__o{i}": F.col(x) if isinstance(x, str) else x for i, x in enumerate(order)} | {"__chance": F.rand(1)}
    numbered = sums_before(rows.withColumns(by), group, list(by), F.lit(1), "__before")
    return numbered.select(*rows.columns, (F.col("__before") + 1).alias(name))
