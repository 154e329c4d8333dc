"""Operator 13: a change feed of every nation's board of best-selling items, by treaps in state.

lines() gives each sale line its batch, arrival day, nation and cents. replay() publishes the batches
one after the other to a watched folder and starts the same streaming query anew for each, on one
checkpoint; a second one, which reads what the first has written, follows in the same way, as one
query of this kind may keep state once only. tens() is the first (1, 2), boards() the second (3):

1. Lines of one item, nation and arrival day are added up in the task that reads them, so that an
   item, vendor or nation that holds much of the input sends few rows.
2. A nation's treap is kept in `shards` parts by a hash of the item, each in the state of its own key:
   delete and reinsert what a day's lines change, traverse ten nodes, compare with the stored ten, and
   pass on what entered, left or changed. So no nation's items go through one task.
3. The state of a nation holds the tens of its shards, whose best ten are the nation's, and its board.
   Days are compared in order; what is passed on is at most ten items a shard and day, however many
   lines there are.

Vendors and items are joined by merging at every size, as both grow with the input; Spark splits what is
uneven. Nothing is broadcast, and what comes to the driver is one number a batch.

Null ids are empty in the hash; lines without a vendor's nation or an item's row are ignored, but do
count for lateness. Repeated lines count each. A repeated vendor or item counts once, by its smallest
nation or price. Arrival days before the first batch's go with the first batch. A board that does not
change gives no row, an empty table gives none at all. Sums are in doubles: exact up to 2^53 cents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from heapq import nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdigris.llm.treap import Treap
from verdigris.sources.work import shared_dir, written

#: First day, days that the batches span, batches, days a line may be late, places of a board.
FIRST_DAY, SPAN, BATCHES, LATE, PLACES = 19723, 180, 8, 15, 10
#: Parts of a nation's treap. They are fixed for the life of a checkpoint, as its partitions are.
SHARDS = 32
#: Rows that a task adds up at once.
HELD_ROWS = 1 << 18

LINE = "nation_id int, item_id long, cents double, arrival_day long, late boolean, batch int"
TEN = "nation_id int, arrival_day long, item_id long, revenue double, listed boolean"
CHANGE = "nation_id int, arrival_day long, item_id long, change string, old_rank int, new_rank int, revenue long"


def batch_of(day: Column) -> Column:
    """The batch of an arrival day, 1 to BATCHES."""
    return F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((day - FIRST_DAY) * BATCHES / F.lit(float(SPAN))))).cast("int")


def lines(sale_lines: DataFrame, vendors: DataFrame, items: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(the lines of LINE, nation and cents null where they are ignored; each batch's latest day)."""
    c = F.col
    text = F.concat_ws(",", *(F.coalesce(c(x).cast("string"), F.lit("")) for x in ("sale_id", "item_id", "vendor_id", "line_no")))
    h = F.crc32(text.cast("binary"))
    days = sale_lines.select("item_id", "vendor_id", "quantity", "amount", "flag", h.alias("h"), F.coalesce(F.unix_date(c("shipped_at").cast("date")).cast("long"), FIRST_DAY + h % 150).alias("day"))
    days = days.withColumn("arrival_day", c("day") + c("h") % 7 + F.when(c("h") % 5 == 0, 20).otherwise(0))
    days = days.withColumn("batch", batch_of(c("arrival_day")))
    latest = {r["batch"]: r["day"] for r in days.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    late, floor = F.when(F.lit(False), False), None
    for batch in range(1, BATCHES + 1):
        late = late.when(c("batch") == batch, F.lit(False) if floor is None else c("day") + LATE < floor)
        floor = max([x for b, x in latest.items() if b <= batch], default=None)
    sign = F.when(c("flag") == "swapped", -1.0).otherwise(1.0)
    known = days.select(
        "item_id", "vendor_id", "arrival_day", "batch", late.alias("late"), (sign * F.floor(100 * c("amount") + 0.5).cast("double")).alias("known"), F.when(c("amount").isNull(), sign * c("quantity")).alias("pieces")
    )
    # written, as Spark splits an uneven join only where both sides come straight from their shuffles
    nations = written(vendors.where("vendor_id is not null").groupBy("vendor_id").agg(F.min("nation_id").alias("nation_id")), "nations")
    prices = written(items.where("item_id is not null").groupBy("item_id").agg(F.min("price").alias("price"), F.lit(True).alias("listed")), "prices")
    cents = F.coalesce(c("known"), c("pieces") * F.floor(100 * c("price") + 0.5), F.lit(0.0))
    joined = known.join(nations.hint("merge"), "vendor_id", "left").drop("vendor_id").join(prices.hint("merge"), "item_id", "left")
    return joined.select(c("nation_id").cast("int").alias("nation_id"), c("item_id").cast("long").alias("item_id"), F.when(c("listed"), cents).alias("cents"), "arrival_day", "late", "batch"), latest


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cents of each nation, shard, day and item, added up as far as the task has seen them."""
    keys, held, size = ["nation_id", "shard", "arrival_day", "item_id"], [], 0

    def summed() -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by(keys).aggregate([("cents", "sum")])
        yield from found.rename_columns([*keys, "cents"] if found.column_names[:4] == keys else ["cents", *keys]).select([*keys, "cents"]).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= HELD_ROWS:
            yield from summed()
            held, size = [], 0
    if held:
        yield from summed()


def frozen(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays))


def thawed(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return [np.ascontiguousarray(raw[i * 8 * n : (i + 1) * 8 * n].reshape(8, n).T).reshape(-1).view(kind) for i, kind in enumerate(kinds)]


def shard_days(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One shard's treap: what enters, leaves or changes in its best ten, day by day."""
    if state.exists:
        n, blob = state.get
        items, revenues = thawed(blob, n, np.int64, np.float64)
        treap = Treap.of(items, revenues)
    else:
        treap = Treap()
    rows = pd.concat(list(frames))
    day, item, cents = (rows[x].to_numpy() for x in ("arrival_day", "item_id", "cents"))
    order = np.lexsort((item, day))
    day, item, cents = day[order], item[order], cents[order]
    treap.know(np.unique(item))
    before, out = dict(treap.top(PLACES)), []
    cuts = np.flatnonzero(np.append(True, day[1:] != day[:-1]))
    item, cents = item.tolist(), cents.tolist()
    for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(day)]):
        at = start
        while at < end:
            x, total = item[at], cents[at]
            at += 1
            while at < end and item[at] == x:  # what other tasks have added up of it
                total += cents[at]
                at += 1
            treap.add(x, total)
        now, d = dict(treap.top(PLACES)), int(day[start])
        out += [(d, i, r, True) for i, r in now.items() if before.get(i) != r]
        out += [(d, i, treap.revenue[treap.node[i]], False) for i in before if i not in now]
        before = now
    items, revenues = treap.entries()
    state.update((len(items), frozen(items, revenues)))
    if out:
        days, ids, revenue, listed = zip(*out)
        yield pd.DataFrame({"nation_id": np.int32(key[0]), "arrival_day": days, "item_id": ids, "revenue": revenue, "listed": listed})


def nation_days(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One nation's board: what enters, leaves or moves, day by day, from the tens of its shards."""
    if state.exists:
        ids, revenue, board = state.get
        tens, board = dict(zip(ids, revenue)), list(board)
    else:
        tens, board = {}, []
    rows = pd.concat(list(frames)).sort_values("arrival_day", kind="stable")
    out = []
    for day, part in rows.groupby("arrival_day", sort=True):
        left = {}
        for i, r, listed in zip(part["item_id"].tolist(), part["revenue"].tolist(), part["listed"].tolist()):
            if listed:
                tens[i] = r
            else:
                tens.pop(i, None)
                left[i] = r
        now = [i for i, _ in nsmallest(PLACES, tens.items(), key=lambda x: (-x[1], x[0]))]
        old, new = {i: k for k, i in enumerate(board, 1)}, {i: k for k, i in enumerate(now, 1)}
        for i in old.keys() | new.keys():
            a, b = old.get(i), new.get(i)
            if a != b:
                out.append((day, i, "enter" if a is None else "exit" if b is None else "move", a, b, int(tens[i] if i in tens else left[i])))
        board = now
    state.update((list(tens), list(tens.values()), board))
    if out:
        found = pd.DataFrame(out, columns=["arrival_day", "item_id", "change", "old_rank", "new_rank", "revenue"])
        found.insert(0, "nation_id", np.int32(key[0]))
        yield found.astype({"old_rank": "Int32", "new_rank": "Int32"})


def tens(stream: DataFrame, shards: int = SHARDS) -> DataFrame:
    """What enters, leaves or changes in the best ten of each shard, from a stream of LINE: rows of TEN."""
    kept = stream.where("not late and nation_id is not null and cents is not null")
    parts = kept.select("nation_id", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard"), "arrival_day", "item_id", "cents")
    sums = parts.mapInArrow(added_up, "nation_id int, shard int, arrival_day long, item_id long, cents double")
    return sums.groupBy("nation_id", "shard").applyInPandasWithState(shard_days, TEN, "n int, nodes binary", "append", GroupStateTimeout.NoTimeout)


def boards(stream: DataFrame) -> DataFrame:
    """What enters, leaves or moves on the nations' boards, from a stream of TEN: rows of CHANGE."""
    return stream.groupBy("nation_id").applyInPandasWithState(nation_days, CHANGE, "items array<long>, revenues array<double>, board array<long>", "append", GroupStateTimeout.NoTimeout)


def started(found: DataFrame, folder: str, name: str) -> None:
    """Runs a streaming query over what is there, from where its checkpoint ends."""
    sink = found.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/checkpoint-{name}")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Moves a batch's finished folder into the watched one, which a stream sees whole or not at all."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def replay(spark: SparkSession, rows: DataFrame, batches: list[int], shards: int = SHARDS, after: Callable[[int, str], None] | None = None) -> DataFrame:
    """The whole feed: rows of LINE, cut into batches that are fed in order to a query started anew for
    each. Everything is kept in a new folder of spark.checkpoint.dir. after(batch, folder) is called
    when a batch is done."""
    folder = f"{shared_dir(spark)}/leaderboard-{uuid.uuid4().hex}"
    rows.write.partitionBy("batch").parquet(f"{folder}/cut")
    for batch in sorted(batches):
        publish(spark, f"{folder}/cut/batch={batch}", f"{folder}/feed/batch={batch}")
        started(tens(spark.readStream.schema(LINE).parquet(f"{folder}/feed"), shards), folder, "tens")
        started(boards(spark.readStream.schema(TEN).parquet(f"{folder}/tens")), folder, "changes")
        if after:
            after(batch, folder)
    return spark.read.schema(CHANGE).parquet(f"{folder}/changes") if batches else spark.createDataFrame([], CHANGE)


def feed(spark: SparkSession, sale_lines: DataFrame, vendors: DataFrame, items: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue)."""
    rows, latest = lines(sale_lines, vendors, items)
    found = replay(spark, rows, list(latest), shards)
    return found.select("nation_id", "arrival_day", "item_id", batch_of(F.col("arrival_day")).alias("batch"), "change", "old_rank", "new_rank", "revenue")


#: The same in DuckDB SQL, by the full grid of nations, days and items; crc32 is spelled out.
SQL = f"""
WITH hashed AS (SELECT *, 4294967295 - list_reduce(list_prepend(CAST(4294967295 AS bigint), list_transform(string_split(concat(coalesce(CAST(sale_id AS varchar), ''), ',', coalesce(CAST(item_id AS varchar), ''), ',', coalesce(CAST(vendor_id AS varchar), ''), ',', coalesce(CAST(line_no AS varchar), '')), ''), lambda x: CAST(ascii(x) AS bigint))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS bigint[])), lambda r, k: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS h FROM sale_lines),
dayed AS (SELECT *, coalesce(CAST(CAST(shipped_at AS date) - DATE '1970-01-01' AS bigint), {FIRST_DAY} + h % 150) AS s FROM hashed),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dayed),
cut AS (SELECT *, CAST(least({BATCHES}, greatest(1, 1 + floor((a - {FIRST_DAY}) * {BATCHES} / {SPAN}.0))) AS int) AS b FROM arrived),
latest AS (SELECT b, max(s) AS m FROM cut GROUP BY b),
floors AS (SELECT x.b, max(y.m) AS floor FROM latest x LEFT JOIN latest y ON y.b < x.b GROUP BY x.b),
kept AS (SELECT v.nation_id AS nation, i.item_id AS item, a, CASE WHEN flag = 'swapped' THEN -1.0 ELSE 1.0 END * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0) AS cents
  FROM cut JOIN floors USING (b) JOIN (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY vendor_id) v ON cut.vendor_id = v.vendor_id JOIN (SELECT item_id, min(price) AS price FROM items GROUP BY item_id) i ON cut.item_id = i.item_id
  WHERE v.nation_id IS NOT NULL AND (floor IS NULL OR s + {LATE} >= floor)),
sums AS (SELECT nation, item, a, CAST(sum(cents) AS double) AS cents FROM kept GROUP BY ALL),
grid AS (SELECT d.nation, d.a, x.item FROM (SELECT DISTINCT nation, a FROM sums) d JOIN (SELECT nation, item, min(a) AS first FROM sums GROUP BY ALL) x ON d.nation = x.nation AND d.a >= x.first),
running AS (SELECT g.nation, g.a, g.item, sum(coalesce(s.cents, 0)) OVER (PARTITION BY g.nation, g.item ORDER BY g.a) AS revenue FROM grid g LEFT JOIN sums s ON g.nation = s.nation AND g.a = s.a AND g.item = s.item),
ranked AS (SELECT *, CASE WHEN revenue > 0 THEN row_number() OVER (PARTITION BY nation, a ORDER BY revenue DESC, item) END AS place FROM running),
boards AS (SELECT nation, a, item, revenue, CASE WHEN place <= {PLACES} THEN place END AS rank, lag(CASE WHEN place <= {PLACES} THEN place END) OVER (PARTITION BY nation, item ORDER BY a) AS was FROM ranked)
SELECT CAST(nation AS int) AS nation_id, a AS arrival_day, item AS item_id, CAST(least({BATCHES}, greatest(1, 1 + floor((a - {FIRST_DAY}) * {BATCHES} / {SPAN}.0))) AS int) AS batch,
  CASE WHEN was IS NULL THEN 'enter' WHEN rank IS NULL THEN 'exit' ELSE 'move' END AS change, CAST(was AS int) AS old_rank, CAST(rank AS int) AS new_rank, CAST(revenue AS bigint) AS revenue
FROM boards WHERE was IS DISTINCT FROM rank
"""
