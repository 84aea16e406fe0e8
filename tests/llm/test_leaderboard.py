"""The change feed against boards that are sorted anew after every day."""

import datetime
import random
import zlib
from collections import defaultdict
from math import floor

from foliant.llm import leaderboard as L

LINES = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, nation_id int, batch int, cents string, h string"


def expected(lines, vendors, items):
    dealt = []
    for sale, no, item, vendor, quantity, amount, _, flag, shipped, *_ in lines:
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, no)).encode())
        s = (shipped.date() - datetime.date(1970, 1, 1)).days if shipped else 19723 + h % 150
        a = s + h % 7 + 20 * (h % 5 == 0)
        price = items.get(item)
        cents = floor(100 * amount + 0.5) if amount is not None else quantity * floor(100 * price + 0.5) if quantity is not None and price is not None else 0
        dealt.append((min(10, 1 + (a - 19723) * 10 // 180), a, s, vendors.get(vendor), item if item in items else None, -cents if flag == "swapped" else cents))
    newest, out = None, []
    revenue, boards = defaultdict(lambda: defaultdict(int)), defaultdict(dict)
    for batch in sorted({d[0] for d in dealt}):
        own = [d for d in dealt if d[0] == batch]
        for day in sorted({d[1] for d in own}):
            for _, _, s, nation, item, cents in (d for d in own if d[1] == day):
                if nation is not None and item is not None and not (newest is not None and s + 3 < newest):
                    revenue[nation][item] += cents
            for nation, found in revenue.items():
                best = sorted((-r, i) for i, r in found.items() if r > 0)[:10]
                new = {i: k + 1 for k, (_, i) in enumerate(best)}
                old = boards[nation]
                for i in old.keys() | new.keys():
                    if old.get(i) != new.get(i):
                        change = "enter" if i not in old else "exit" if i not in new else "move"
                        out.append((nation, day, i, batch, change, old.get(i), new.get(i), found[i]))
                boards[nation] = new
        newest = max([d[2] for d in own] + ([newest] if newest is not None else []))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue").collect()), key=repr)


def test_feed_agrees_with_boards_sorted_every_day(spark):
    rng = random.Random(11)
    lines = []
    for k in range(1500):
        shipped = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=min(149, int(k / 10) + rng.randint(0, 4)), hours=rng.randint(0, 23))
        item = rng.choice([7, 7, 7, 1 << 60, *range(40)])
        lines.append([rng.choice((None, k)), rng.randint(1, 4), rng.choice((None, item, item, item, 999)), rng.choice((None, *range(6), 0, 0, 0)), rng.choice((None, 1, 5)), rng.choice((None, None, 10.0, 20.0, 0.125, 3.33)), 0.0,
                      rng.choice(("kept", "kept", "swapped", None)), rng.choice((None, shipped, shipped)), 99, 77, "x", "y"])
    lines += [list(x) for x in lines[:40]] * 2
    vendors = {0: 5, 1: 5, 2: 6, 3: None, 4: -1, 5: 0}
    items = {k: (None if k % 9 == 4 else 2.5 * k) for k in range(40)} | {1 << 60: 1.0}
    v = spark.createDataFrame([(k, n, "x") for k, n in [*vendors.items(), (0, 5)]] + [(None, 1, "x")], "vendor_id bigint, nation_id int, item_id string")
    i = spark.createDataFrame([(k, p, 1) for k, p in [*items.items(), (3, 7.5)]] + [(None, 1.0, 1)], "item_id bigint, price double, cents int")
    want = sorted(expected(lines, vendors, items), key=repr)
    assert len(want) > 300
    got = rows(L.feed(L.cut(spark.createDataFrame(lines, LINES), v, i), 3))
    assert got == want


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], LINES)
    vendors, items = spark.createDataFrame([], "vendor_id bigint, nation_id int"), spark.createDataFrame([], "item_id bigint, price double")
    assert L.feed(L.cut(none, vendors, items), 8).count() == 0


def test_lines_without_nation_or_item_give_no_board(spark):
    lines = spark.createDataFrame([(1, 1, 1, 1, 1, 1.0, 0.0, "kept", None, 0, 0, "", "")], LINES)
    vendors, items = spark.createDataFrame([], "vendor_id bigint, nation_id int"), spark.createDataFrame([(1, 2.0)], "item_id bigint, price double")
    assert L.feed(L.cut(lines, vendors, items), 8).count() == 0


def test_stale_entries_never_surface():
    rng = random.Random(2)
    board, plain = L.Board({}), {}
    for _ in range(3000):
        item, revenue = rng.randint(0, 30), rng.randint(-5, 40)
        board.put(item, revenue)
        plain[item] = revenue
        if rng.random() < 0.3:
            assert list(board.best().items()) == [(i, r) for r, i in sorted((-r, i) for i, r in plain.items() if r > 0) for r in [-r]][:10]
    again = L.Board(L._pairs(*L._packed(board.revenue)))
    assert again.best() == board.best()


def test_combining_keeps_sums_and_days():
    import pyarrow as pa

    rng = random.Random(6)
    rows = [(rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 3), rng.randint(0, 3), rng.randint(-9, 9), True, 1) for _ in range(500)]
    names = ["nation_id", "item_id", "event_day", "arrival_day", "cents", "counted", "batch"]
    table = pa.table([list(c) for c in zip(*rows, strict=True)], names)
    out = [tuple(r[n] for n in names) for b in L._combined(iter(table.to_batches(max_chunksize=50))) for r in b.to_pylist()]
    want = defaultdict(int)
    for r in rows:
        want[r[:4]] += r[4]
    assert {r[:4]: r[4] for r in out} == want and len(out) == len(want)


def test_shards_grow_slowly():
    assert L.shards_for(0) == 8 and L.shards_for(10**7) == 16 and L.shards_for(10**12) == 5000
