"""Operator 8: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, in which neighbours differ in few bits, and cut into
ranges of about equal size. A range's upper node holds the bits that all its fingerprints share
(mask and pattern); a range has a tree of such nodes below it, each holding what its group
shares beyond its parent. A search goes down from the top, adds up the differences with each
node's pattern, and drops a whole group once they exceed the radius. So no link is lost, and
a fingerprint is only sent to the ranges whose upper node it comes near to.

Each range reports a spanning forest of the links it finds, never the links themselves; large
and small stars, cut by checkpoints, join the forests into components. The upper nodes, at most
MAX_NODES, are all that comes to the driver. Equal fingerprints are one row from the start,
summed up in the tasks first, so a group of copies weighs no more than one document.

Whole texts are taken, however long: a text's shingles are held by the one task that reads it. A null
text has no words: fingerprint zero, linked like any other. A null key never names a
component unless all of a component's keys are null; repeated keys and rows are kept one by
one. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import checkpointed, free, hot_join, written

SEED = 42
#: Fingerprints in a range, at least about, and ranges at most.
RANGE, MAX_NODES = 1 << 14, 50_000
#: Children of a tree node; queries that go down a tree at a time.
FAN, BLOCK = 8, 128

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LANE = np.uint64(0x0101010101010101)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; of all words, if there are fewer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    runs = zip(*(found[k:] for k in range(words)))
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; zero without any."""
    n = len(hashes)
    if not n:
        return 0
    counts, starts = np.zeros((8, 8), np.int64), np.arange(0, n, 255)
    for bit in range(8):  # byte lanes that hold up to 255 each
        counts[:, bit] = np.add.reduceat((hashes >> np.uint64(bit)) & _LANE, starts).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts.ravel() > n, bitorder="little").view("<u8")[0])


def wide(hashes: np.ndarray, parts: int) -> list[int]:
    """A fingerprint of parts times 64 bits; each part mixes the hashes anew."""
    out = []
    for k in range(parts):
        h = (hashes ^ np.uint64(k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * _ODD
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(majority(h ^ (h >> np.uint64(29))))
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.int64).view(np.uint64)


class GrayTree:
    """The hierarchical index of items (mask, pattern), which are in Gray order of the patterns.

    An item that is a fingerprint has a full mask; an upper node of a range has the mask of the
    bits its range shares.
    """

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None):
        masks = np.full(len(patterns), _ALL) if masks is None else masks
        self.levels = [(patterns, masks)]
        while len(patterns) > FAN:
            starts = np.arange(0, len(patterns), FAN)
            both, either = np.bitwise_and.reduceat(patterns, starts), np.bitwise_or.reduceat(patterns, starts)
            masks = np.bitwise_and.reduceat(masks, starts) & ~(both ^ either)
            patterns = both & masks
            self.levels.append((patterns, masks))
        self.levels.reverse()
        for k in range(len(self.levels) - 1, 0, -1):  # keep what a node shares beyond its parent
            patterns, masks = self.levels[k]
            own = masks & ~np.repeat(self.levels[k - 1][1], FAN)[: len(masks)]
            self.levels[k] = (patterns & own, own)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, item) index pairs within the radius, a block of queries at a time."""
        for at in range(0, len(queries), BLOCK):
            block = queries[at : at + BLOCK]
            top = len(self.levels[0][0])
            q, node = np.repeat(np.arange(len(block)), top), np.tile(np.arange(top), len(block))
            far = np.zeros(len(q), np.int16)
            for k, (patterns, masks) in enumerate(self.levels):
                if k:
                    q, far = np.repeat(q, FAN), np.repeat(far, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    real = node < len(patterns)
                    q, far, node = q[real], far[real], node[real]
                far = far + np.bitwise_count((block[q] ^ patterns[node]) & masks[node])
                near = far <= radius
                q, node, far = q[near], node[near], far[near]
            yield q + at, node


class Forest:
    """Union by smaller index."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, a: int) -> int:
        root = self.root
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    def join(self, pairs_a: np.ndarray, pairs_b: np.ndarray) -> None:
        for a, b in zip(pairs_a.tolist(), pairs_b.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the component's least node.

    Large and small stars in turn until nothing changes; a hub's edges are never gathered, only
    its least neighbour is, and joined back.
    """

    def turned(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def settled(e: DataFrame) -> bool:
        """Whether each node either has one edge down or only edges from above."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()

    def star(e: DataFrame, large: bool) -> DataFrame:
        low, high = F.least("a", "b"), F.greatest("a", "b")
        near = turned(e) if large else e.select(high.alias("a"), low.alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        seen = near.join(least, "a")
        out = seen.where(F.col("b") > F.col("a") if large else F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not settled(edges):
        edges = checkpointed(star(star(edges, large=True), large=False))
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def named_groups(items: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """items (key, least, n) with the root of each, itself if it has none in roots (node, root), and
    group_id, the least of the root's. No root's items meet in one task."""
    joined = checkpointed(items.join(roots, items[key] == roots.node, "left").select(*items.columns, "root"))
    rooted = joined.where("root is not null")
    groups = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("group_id"), F.count("*").alias("n")))
    grouped = hot_join(rooted.withColumnRenamed("n", "rows"), groups, "root").withColumnRenamed("rows", "n")
    alone = joined.where("root is null").withColumns({"root": F.col(key), "group_id": F.col("least")})
    return grouped.select(*items.columns, "root", "group_id").unionByName(alone.select(*items.columns, "root", "group_id"))


def spanning_edges(items: DataFrame, radius: int, payload_radius: int | None = None, least_range: int | None = None) -> DataFrame:
    """Spanning edges (a, b) of the links among items (code long, item long, payload binary).

    Codes link within the radius; with a payload radius, only if the payloads' bits also differ
    in no more than that. An item may have several codes. A range holds at least about least_range
    codes, RANGE if none is given: the larger the ranges, the fewer of them a code calls on.
    """
    spark = items.sparkSession
    n = items.count()
    size = max(least_range or RANGE, -(-n // MAX_NODES))
    ranges = max(1, -(-n // size))

    def ordered(batches: Iterator) -> Iterator:
        for b in batches:
            rank = gray_rank(unsigned(b.column("code").to_numpy(zero_copy_only=False))) ^ np.uint64(1 << 63)
            yield pa.RecordBatch.from_arrays([pa.array(signed(rank)), *b.columns], names=["gray", "code", "item", "payload"])

    ranked = items.select("code", "item", "payload").mapInArrow(ordered, "gray long, code long, item long, payload binary")
    dealt = ranked.repartitionByRange(ranges, "gray").withColumn("node", F.spark_partition_id())
    table = written(dealt.select("node", "gray", "code", "item", "payload"), "gray-ranges")
    nodes = table.groupBy("node").agg(F.min("gray").alias("gray"), F.bit_and("code").alias("both"), F.bit_or("code").alias("either")).orderBy("gray").collect()
    both, either = (unsigned([r[k] for r in nodes]) for k in ("both", "either"))
    shared = ~(both ^ either)
    upper = spark.sparkContext.broadcast((np.array([r["node"] for r in nodes], np.int32), both & shared, shared))

    packed = pa.schema([("node", pa.int32()), ("guest", pa.bool_()), ("codes", pa.binary()), ("items", pa.binary()), ("payloads", pa.binary())])

    def route(batches: Iterator) -> Iterator:
        """Packs what is at home in each range and what calls on it, a row for each of both."""
        names, patterns, masks = upper.value
        tree, place = GrayTree(patterns, masks), {int(x): k for k, x in enumerate(names)}
        for b in batches:
            own = np.array([place[x] for x in b.column("node").to_pylist()])
            codes, item = (b.column(c).to_numpy(zero_copy_only=False) for c in ("code", "item"))
            payload = None if payload_radius is None else np.frombuffer(b"".join(b.column("payload").to_pylist()), np.uint8).reshape(len(codes), -1)
            calls = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for q, node in tree.search(unsigned(codes), radius):
                later = node > own[q]  # its own range has it; of two ranges the later one looks
                calls.append((q[later], node[later]))
            rows = []
            for guest, (q, node) in ((False, (np.arange(len(codes)), own)), (True, tuple(np.concatenate(x) for x in zip(*calls)))):
                order = np.argsort(node, kind="stable")
                targets, starts = np.unique(node[order], return_index=True)
                for target, part in zip(targets, np.split(q[order], starts[1:])):
                    rows.append((names[target], guest, codes[part].tobytes(), item[part].tobytes(), None if payload is None else payload[part].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), packed)], schema=packed)

    def links(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["guest"], r["codes"], r["items"]))
        codes, item = (np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in ("codes", "items"))
        guest = np.repeat([r["guest"] for r in rows], [len(r["codes"]) // 8 for r in rows])
        codes = unsigned(codes)
        order = np.lexsort((item, gray_rank(codes), guest))
        codes, item, home = codes[order], item[order], int((~guest).sum())
        payload = None
        if payload_radius is not None:
            payload = np.frombuffer(b"".join(r["payloads"] for r in rows), "<u8").reshape(len(item), -1)[order]
        forest, tree = Forest(len(item)), GrayTree(codes[:home])
        label = np.arange(len(item))
        for q, found in tree.search(codes, radius):
            new = (found < q) & (label[q] != label[found])
            q, found = q[new], found[new]
            if payload is not None and len(q):
                near = np.zeros(len(q), bool)
                for at in range(0, len(q), 1 << 18):
                    part = slice(at, at + (1 << 18))
                    near[part] = np.bitwise_count(payload[q[part]] ^ payload[found[part]]).sum(1) <= payload_radius
                q, found = q[near], found[near]
            if len(q):
                forest.join(q, found)
                if len(q) > 4 * BLOCK:  # spare later blocks the links that say nothing new
                    label = np.array([forest.find(i) for i in range(len(item))])
        root = np.array([forest.find(i) for i in range(len(item))], np.int64)
        joined = np.flatnonzero(item[root] != item)
        return pa.table({"a": item[joined], "b": item[root[joined]]})

    return table.mapInArrow(route, "node int, guest boolean, codes binary, items binary, payloads binary").groupBy("node").applyInArrow(links, "a long, b long")


def fingerprints(df: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row. Map-only."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            found = np.array([majority(shingle_hashes(t.as_py(), words)) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(signed(found))], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def near_duplicates(df: DataFrame, *, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of each row; fingerprints link within the radius."""
    marked = written(fingerprints(df, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    edges = spanning_edges(distinct.select(F.col("fp").alias("code"), F.col("fp").alias("item"), F.lit(None).cast("binary").alias("payload")), radius)
    named = checkpointed(named_groups(distinct, components(edges), "fp").select("fp", F.col("group_id").alias("component_id"), "n"))
    out = hot_join(marked, named, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Two texts are copies if they share this part (over, under) of their distinct shingles.
ALIKE = (4, 5)
#: What proposes pairs: parts of 64 bits of a wide fingerprint, bits of each code cut from it,
#: parts that are compared as a whole, and bits in which those may differ.
PARTS, CODE_BITS, WHOLE, COPY_BITS = 6, 24, 2, 34
#: Codes in a range, at least about.
COPY_RANGE = 1 << 17
#: Texts that are compared at a time, for the worker's memory.
SLICE = 64
#: Texts, and bytes of them, in a block of a group; two blocks at a time meet in a task.
CELL_ITEMS, CELL_BYTES = 256, 4 << 20


def codes_of(parts: list[int]) -> list[int]:
    """The codes of a wide fingerprint. A code's number is written three times above it, so
    codes with different numbers differ in three bits at least and never link."""
    whole = sum(p << (64 * k) for k, p in enumerate(parts))
    out = []
    for k in range(64 * len(parts) // CODE_BITS):
        out.append((k << (CODE_BITS + 16) | k << (CODE_BITS + 8) | k << CODE_BITS) | (whole >> (CODE_BITS * k) & ((1 << CODE_BITS) - 1)))
    return out


def mark_of(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def alike(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(a, b, alike) of each pair (a, b) of texts (item, text): whether they share the part ALIKE of
    their distinct shingles, by all of both."""
    over, under = ALIKE

    def run(batches: Iterator) -> Iterator:
        name, mine = None, None
        for b in batches:
            found = []
            for at in range(0, b.num_rows, SLICE):
                for a, x, y in zip(*(b.column(c).slice(at, SLICE).to_pylist() for c in ("a", "mine", "theirs"))):
                    if a != name:
                        name, mine = a, np.unique(shingle_hashes(x, words))
                    theirs = np.unique(shingle_hashes(y, words))
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    found.append(under * both >= over * (len(mine) + len(theirs) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(found, pa.bool_())], names=["a", "b", "alike"])

    sided = pairs.join(texts.toDF("b", "theirs"), "b").join(texts.toDF("a", "mine"), "a")
    return sided.select("a", "b", "mine", "theirs").mapInArrow(run, "a long, b long, alike boolean")


def cells(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(group, lo, hi, block, item, label, payload, text): the items (item, label, payload, group) of each
    group that has several labels, dealt into blocks by a hash, once for each block that theirs has to
    meet. A cell (lo, hi) holds two blocks, or one, so its size is bounded whatever the group's is."""
    sizes = texts.select("item", F.octet_length("text").alias("bytes"))
    held = checkpointed(items.join(sizes, "item"))
    groups = held.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where("least <> most")
    split = checkpointed(groups.select("group", "n", F.greatest(F.lit(1), F.ceil(F.col("n") / CELL_ITEMS), F.ceil(F.col("bytes") / CELL_BYTES)).alias("blocks")))
    inside = hot_join(held.drop("bytes"), split, "group").join(texts, "item")
    met = inside.withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select("group", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "item", "label", "payload", "text")


def links_across(cell: DataFrame, words: int) -> DataFrame:
    """Spanning edges (a, b) of the alike texts of different labels in each cell, among the pairs that the
    index proposes: each proposed pair is held against the texts unless it is joined already."""
    over, under = ALIKE

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        item, block, label = (table.column(c).to_numpy() for c in ("item", "block", "label"))
        parts = np.frombuffer(b"".join(table.column("payload").to_pylist()), "<u8").reshape(len(item), PARTS)
        codes = np.array([codes_of(p.tolist()) for p in parts], np.int64)
        place = np.unique(label, return_inverse=True)[1].tolist()
        groups, sets, edges = Forest(len(place)), {}, []

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.unique(shingle_hashes(table.column("text")[i].as_py(), words))
            return sets[i]

        one = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        for i in range(1, len(item)):
            new = label[:i] != label[i]
            if not one:
                new &= block[:i] != block[i]
            new &= np.bitwise_count(parts[:i, :WHOLE] ^ parts[i, :WHOLE]).sum(1) <= COPY_BITS
            near = np.flatnonzero(new)
            near = near[(np.bitwise_count(codes[near] ^ codes[i]) <= 2).any(1)]
            for j in near.tolist():
                if groups.find(place[i]) == groups.find(place[j]):
                    continue
                mine, theirs = shingles(i), shingles(j)
                if under * min(len(mine), len(theirs)) < over * max(len(mine), len(theirs)):
                    continue  # the shared part is at most that of their sizes
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                if under * both >= over * (len(mine) + len(theirs) - both):
                    edges.append((item[i], item[j]))
                    groups.join(np.array([place[i]]), np.array([place[j]]))
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return cell.groupBy("group", "lo", "hi").applyInArrow(compare, "a long, b long")


def marked_groups(df: DataFrame, *, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, root, group_id) of each row: copies by the distinct five-word shingles of whole
    texts. mark is a hash of the text, and root names the group.

    The index only proposes pairs: those whose wide fingerprints have some code that differs in
    at most two bits, and differ in at most COPY_BITS bits of the parts compared as a whole. A
    proposed pair links if the texts are alike. First a spanning forest of the proposals is
    held against the texts. Where an edge of it fails, the texts that it had joined meet, block
    by block, and all proposals between the groups left apart are held against the texts there;
    so a proposal is left out only if its texts are in one group already, and pairs are never
    rows. Texts with the same shingles are one item. group_id is the least key of the group.
    """

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            found = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column("text")]
            payload = [np.array(wide(h, PARTS), "<u8").tobytes() for h in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63) for h in found], pa.int64()), pa.array(payload, pa.binary())], names=["id", "mark", "item", "payload"])

    def coded(batches: Iterator) -> Iterator:
        for b in batches:
            parts = [np.frombuffer(p, "<u8") for p in b.column("payload").to_pylist()]
            codes = [codes_of(p.tolist()) for p in parts]
            at = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            seen = pa.array([p[:WHOLE].tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x for c in codes for x in c], pa.int64()), b.column("item").take(pa.array(at)), seen.take(pa.array(at))], names=["code", "item", "payload"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), mark_of(text_col).alias("mark"), F.col(text_col).alias("text"))
    marked = written(rows.mapInArrow(run, f"id {kind}, mark long, item long, payload binary"), "wide-fingerprints")
    distinct = checkpointed(marked.groupBy("item").agg(F.min("id").alias("least"), F.min("mark").alias("mark"), F.first("payload").alias("payload"), F.count("*").alias("n")))

    codes = distinct.select("item", "payload").mapInArrow(coded, "code long, item long, payload binary")
    edges = spanning_edges(codes, 2, COPY_BITS, COPY_RANGE)
    first = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    near = distinct.join(first.select("a").union(first.select("b")).distinct().toDF("item"), "item")
    texts = written(rows.join(near.select("item", "mark"), "mark").select("item", "text").dropDuplicates(["item"]), "near-texts")
    judged = checkpointed(alike(first, texts, words))
    sure = judged.where("alike").select("a", "b")
    roots = components(sure)
    labels = near.join(roots, near.item == roots.node, "left").select("item", "payload", F.coalesce("root", "item").alias("label"))
    grouped = labels.join(components(first).toDF("item", "group"), "item")
    more = checkpointed(links_across(cells(grouped, texts), words))
    if not more.isEmpty():
        roots = components(sure.union(more))
    named = checkpointed(named_groups(distinct.select("item", "least", "n"), roots, "item").select("item", "root", "group_id", "n"))
    return hot_join(marked.select("id", "mark", "item"), named, "item").select(F.col("id").alias(id_col), "mark", "root", "group_id")


def copy_groups(df: DataFrame, *, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id) of each row."""
    return marked_groups(df, words=words, id_col=id_col, text_col=text_col).select(id_col, "group_id")


def keep_one(df: DataFrame, *, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, whole, one for each group of copies: that with the least key.

    Rows without a key stand under a hash of their text. Rows that share a key are told apart by
    their text; of equal rows one stays. Keys that are no whole numbers are compared as text.
    """
    stand_in = F.lit(-(1 << 62)) + F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) % F.lit(1 << 61)
    kind = "long" if df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"
    key = F.coalesce(F.col(id_col).cast(kind), stand_in.cast(kind))
    own = free("__key", df.columns)
    of = free("__mark", df.columns)
    groups = marked_groups(df.select(key.alias("key"), F.col(text_col).alias("text")), words=words, id_col="key")
    chosen = groups.groupBy("root").agg(F.min(F.struct("key", "mark")).alias("one")).select(F.col("one.key").alias(own), F.col("one.mark").alias(of))
    kept = df.withColumns({own: key, of: mark_of(text_col)}).join(chosen, [own, of], "left_semi")
    return kept.dropDuplicates([own, of]).select(df.columns)
