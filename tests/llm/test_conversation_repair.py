"""Repairs against a search over all edits, which compares whole strings of initials."""

import hashlib
import random
from functools import lru_cache

import pytest
from foliant.llm import conversation_repair as R

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROWS = "conv_id bigint, turn bigint, role string, text string, cost int, piece string, n int"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by trying every edit at every row."""
    kinds = faults(rows)

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def add(cost, label, to, line, at, again):
            c, audit, lines = best(at, to, again)
            found.append((c + cost, label + audit, line + lines))

        if inserted < 4:
            for role in ("user", "assistant"):
                if (state, role[0]) in NEXT:
                    add(3, "I", NEXT[state, role[0]], (f"{role}:",), i, inserted + 1)
        if i < len(rows):
            (role, text), kind = rows[i], kinds[i]
            add(4, "D", state, (), i + 1, 0)
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                if (state, role[:1]) in NEXT:
                    add(more, "K", NEXT[state, role[:1]], (f"{role}:{text}",), i + 1, 0)
                for to in ("user", "assistant"):
                    if (state, to[0]) in NEXT:
                        add(3 + more, "R", NEXT[state, to[0]], (f"{to}:{text}",), i + 1, 0)
        return min(found, default=(10**9, "", ()))

    return best(0, 0, 0)


def told(rows):
    """The report of a conversation's (turn, role, text) rows."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
    kinds = faults([r[1:] for r in rows])
    cost, audit, lines = cheapest([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n):
    rng = random.Random(seed)
    out = []
    for conv in [None, *range(n)]:
        for _ in range(rng.choice((1, 2, 3, 5, 9))):
            turn = rng.choice((None, 0, 1, 2, 3, 4, 7))
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None))
            out += [(conv, turn, role, rng.choice(("A a.", "B b!", "c", "", " \n", None, "é?", "d. \t", "x" * 50)), 1, "k", 2)] * rng.choice((1, 1, 1, 2))
    return out


@pytest.mark.parametrize("size", [4096, 2])
def test_repairs_agree_with_brute_force(spark, size):
    made = conversations(size, 60)
    rows = spark.createDataFrame(made, ROWS)
    every = spark.createDataFrame([(k,) for k in [None, *range(62)]], "conv_id bigint")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r[n] for n in names) for r in R.report(rows, every, size).collect()}
    want = {k: told([r[1:4] for r in made if r[0] == k]) for k in [None, *range(60)]}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == want | {60: none, 61: none}


def test_a_piece_cut_anywhere_costs_the_same():
    rng = random.Random(4)
    for _ in range(200):
        symbols = [(rng.choice("suat"), rng.randrange(3)) for _ in range(rng.randint(2, 9))]
        cut = rng.randrange(1, len(symbols))
        whole, choices = R.search([*symbols, None], R.CLOSED)
        after, _ = R.search([*symbols[cut:], None], R.CLOSED)
        m = R.matrix(symbols[:cut])
        assert whole == [min(m[4 * s + e] + after[e] for e in R.STATES) for s in R.STATES]
        assert R.follow(choices, 0)[1] in R.ENDS


def test_repaired_rows_obey_the_grammar(spark):
    import re

    made = conversations(9, 40)
    out = {}
    for r in sorted(R.repair(spark.createDataFrame(made, ROWS)).collect(), key=lambda r: (r.piece, r.place)):
        out.setdefault(r.conv_id, []).append(r)
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
    assert out and all(re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in rows)) for rows in out.values())


def test_long_conversations_spread_over_pieces_and_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k}.", 0, "", 0) for k in range(2000) if k % 97] + [(2, 0, "user", "x" * 500_000 + ".", 0, "", 0), (2, 1, "assistant", "ok.", 0, "", 0)]
    df = spark.createDataFrame(rows, ROWS)
    cut = R.pieces(df, 64)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut.count() > 30 and len({r.piece >> 40 for r in cut.select("piece").collect()}) > 1
    got = {r.conv_id: r for r in R.report(df, df, 64).collect()}
    assert len(got[1].audit.replace("I", "")) == len(rows) - 2 and got[1].gaps == 20 and got[2].audit == "KK"
    assert (got[1].blank, got[1].duplicate, got[1].truncated, got[1].illegal) == (0, 0, 0, sum(a[2] == b[2] for a, b in zip(rows[:-2], rows[1:-2], strict=False)))


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert R.report(R.damaged(none), none).count() == 0 and R.repair(none).count() == 0


def test_damage_of_nulls(spark):
    import zlib

    made = [(c, t, r, x, 0, "", 0) for c in (None, *range(60)) for t, r, x in ((None, None, None), (1, "assistant", "a. b! c?"))]
    got = sorted((r.conv_id is None, r.conv_id or 0, r.turn is None, r.role, r.text) for r in R.damaged(spark.createDataFrame(made, ROWS)).collect())
    want = []
    for c, t, r, x, *_ in made:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k:
            x = "" if k == 1 else x.replace(".", "").replace("!", "").replace("?", "") if k == 2 else x
            want += [(c is None, c or 0, t is None, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    assert got == sorted(want)


def test_query_agrees_with_sql(spark):
    from foliant.llm import oracles, queries
    from oracle import SF, connect, same

    same(queries.QUERIES["op13_conversation_repair"](spark, SF), oracles.ORACLES["op13_conversation_repair"], connect())
