import datetime as dt
import json
import os
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.llm import leaderboard as L
from verdigris.llm.treap import Treap

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at timestamp_ntz, batch string, day int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-6, 30), st.integers(-60, 90)), max_size=200))
def test_treap_keeps_order_ranks_and_sizes(moves):
    treap, plain = Treap(), {}
    treap.know(np.array([i for i, _ in moves], np.int64))
    for item, cents in moves:
        treap.add(item, float(cents))
        plain[item] = plain.get(item, 0) + cents
        want = sorted(((i, float(r)) for i, r in plain.items() if r > 0), key=lambda x: (-x[1], x[0]))
        assert treap.top(10) == want[:10]
        assert treap.size[treap.root] == len(want)
    for place, (item, revenue) in enumerate(want if moves else [], 1):
        assert treap.rank(item) == place and treap.select(place) == (item, revenue)
    assert treap.select(len(plain) + 1) is None
    again = Treap.of(*treap.entries())
    assert again.top(1000) == treap.top(1000) and again.size[again.root] == treap.size[treap.root]
    assert {i: again.revenue[n] for i, n in again.node.items()} == {i: treap.revenue[n] for i, n in treap.node.items()}
    for n in range(1, len(again.item)):
        assert all(again.priority[c] <= again.priority[n] for c in (again.left[n], again.right[n]) if c)


def made(n, seed):
    """Lines in which a third has one item, vendor and nation, with nulls, repeats and late ones."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        hot = rng.random() < 0.33
        day = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(150), seconds=rng.randrange(86400))
        row = (rng.randrange(50), rng.choice([1, 2, None]), 7 if hot else rng.choice([None, *range(40)]), 1 if hot else rng.choice([None, *range(9)]), rng.choice([None, 1, 5]), rng.choice([None, 0.005, 1.15, 9.99, 20.0]), rng.choice(["kept", "swapped", "swapped", "returned", None]), None if rng.random() < 0.05 else day, "clash", 3)
        rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


VENDORS = [(i, i % 3 if i != 5 else None, "x") for i in range(8)] + [(None, 1, "null"), (2, 1, "repeated")]
ITEMS = [(i, 2.5 + i if i % 4 else None, "x") for i in range(35)] + [(None, 1.0, "null"), (3, 2.25, "repeated")]


def plain(rows):
    """The feed by plain loops over days and dictionaries."""
    nation, price = defaultdict(list), defaultdict(list)
    for v, n, _ in VENDORS:
        nation[v].append(n)
    for i, p, _ in ITEMS:
        price[i].append(p)
    low = lambda x: min((y for y in x if y is not None), default=None)
    cut = []
    for sale, line, item, vendor, quantity, amount, flag, shipped, *_ in rows:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = 19723 + h % 150 if shipped is None else (shipped.date() - dt.date(1970, 1, 1)).days
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        cut.append((min(8, 1 + (a - 19723) * 8 // 180), s, a, item, vendor, quantity, amount, flag))
    total, days = defaultdict(float), defaultdict(lambda: defaultdict(list))
    for b, s, a, item, vendor, quantity, amount, flag in cut:
        before = [x[1] for x in cut if x[0] < b]
        if before and s + 15 < max(before):
            continue
        n = low(nation[vendor]) if vendor is not None else None
        if n is None or item is None or item not in price:
            continue
        p = low(price[item])
        cents = np.floor(100 * amount + 0.5) if amount is not None else quantity * np.floor(100 * p + 0.5) if quantity is not None and p is not None else 0.0
        days[a][n].append((item, -cents if flag == "swapped" else cents))
    boards, out = defaultdict(dict), []
    for a in sorted(days):
        for n, found in days[a].items():
            for item, cents in found:
                total[n, item] += cents
            best = sorted(((-r, i) for (m, i), r in total.items() if m == n and r > 0))[:10]
            now = {i: k for k, (_, i) in enumerate(best, 1)}
            for i in boards[n].keys() | now.keys():
                x, y = boards[n].get(i), now.get(i)
                if x != y:
                    out.append((n, a, i, min(8, 1 + (a - 19723) * 8 // 180), "enter" if x is None else "exit" if y is None else "move", x, y, int(total[n, i])))
            boards[n] = now
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = made(900, 5)
    frames = spark.createDataFrame(rows, LINES), spark.createDataFrame(VENDORS, "vendor_id long, nation_id int, name string"), spark.createDataFrame(ITEMS, "item_id long, price double, listed string")
    return rows, frames


def test_feed_equals_plain_loops_and_sql(spark, tables):
    rows, frames = tables
    seen = []

    def look(batch, folder):
        folder = folder.removeprefix("file://")
        offsets = [x for x in os.listdir(f"{folder}/checkpoint-tens/offsets") if x.isdigit()]
        seen.append((batch, len(offsets), json.load(open(f"{folder}/checkpoint-tens/metadata"))["id"]))

    want = sorted(plain(rows), key=str)
    cut, latest = L.lines(frames[0].repartition(3), frames[1], frames[2])
    got = L.replay(spark, cut, list(latest), shards=3, after=look).withColumn("batch", L.batch_of(F.col("arrival_day")))
    got = got.select("nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {x[4] for x in want} == {"enter", "exit", "move"} and len({x[3] for x in want}) > 5
    # every batch starts the query anew, on one checkpoint
    assert [x[:2] for x in seen] == [(k, k) for k in range(1, 9)] and len({x[2] for x in seen}) == 1
    con = duckdb.connect()
    for name, frame in zip(("sale_lines", "vendors", "items"), frames):
        con.register(name, frame.toArrow())
    assert sorted(con.execute(L.SQL).fetchall(), key=str) == want


def test_empty_tables(spark, tables):
    assert L.feed(spark, tables[1][0].where("false"), tables[1][1], tables[1][2]).count() == 0
    few = tables[1][0].where("shipped_at < timestamp_ntz '2024-01-03'")
    assert L.feed(spark, few, tables[1][1].where("false"), tables[1][2]).count() == 0
