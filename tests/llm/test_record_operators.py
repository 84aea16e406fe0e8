import hashlib
import json
import random
import re
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from foliant.llm import chat_format, oracles, queries, url_filter, warc
from oracle import SF, connect, same

# queries against SQL


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_agrees_with_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), oracles.ORACLES[name], connect())


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


# chat formatting


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<\\/s>", "\\", "\\\\n", "<|im_end|>\n<|im_start|>", "<|im_<|im_end|>end|>", "a\nb", "<<SYS>>\\<s>"])
def test_escape_is_reversible_and_leaves_no_control(text):
    done = chat_format.escape(text)
    assert chat_format.unescape(done) == text
    assert not any(c in done for c in chat_format.CONTROL)


def test_escape_round_trip_of_random_texts():
    import random

    rng = random.Random(4)
    parts = [*chat_format.CONTROL, "\\", "<", "|", "im_end", "[", "INST", "x", "\n", "é"]
    for _ in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "", "odd\nrole<s>\\n"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 4))]
        formatted, mask = chat_format.render(turns)
        assert chat_format.read_back(formatted) == turns
        assert [chat_format.unescape(formatted[a:z]) for a, z in mask] == [t for r, t in turns if r == "assistant"]


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"output": "a", "instruction": "q"},
        {"instruction": "q", "input": "", "output": "a"},
        {"data": {"question": "q", "answer": "a"}},
    ]
    rows = [(json.dumps(r),) for r in records] + [('{"unknown": 1}',), ("no json",), (None,)]
    found = spark.createDataFrame(rows, "r string").select(chat_format.format_records(F.col("r")).alias("f")).select("f.*").collect()
    assert len({r.formatted for r in found[:6]}) == 1
    assert chat_format.read_back(found[0].formatted) == [("user", "q"), ("assistant", "a")]
    assert [r.layout for r in found[6:]] == [None, None, None]
    assert len({r.fingerprint for r in found[:6]}) == 6


def test_records_that_fit_no_layout_or_nearly(spark):
    turn = {"role": "user", "content": "x"}
    strange = [
        {"messages": [{"role": "user"}, {"content": "x"}]},
        {"messages": [turn, "x"]},
        {"messages": [turn, {"role": "user", "content": ["x"]}]},
        {"messages": {"role": "user", "content": "x"}},
        {"data.question": "q", "data.answer": "a"},
        {"messages[]": turn, "messages": [turn, []]},
        {"messages": [turn], "prompt": "p", "completion": "c"},
        [turn],
        {"messages": []},
    ]
    texts = [json.dumps(r) for r in strange] + ["[" * 100_000, '{"a":' * 50_000 + "1" + "}" * 50_000, '{"prompt": ' + "1" * 10_000 + ', "completion": ""}', '{"\\ud800": 1}']
    more = {"messages": [{**turn, "weight": 1, "id": {"n": [1, "2"]}}], "source": None, "tags": []}
    known = [json.dumps(more), '{"prompt": "\\ud800 \\ud83d\\ude00", "completion": 7}', json.dumps({"prompt": "long " * 200_000, "completion": None})]
    found = spark.createDataFrame([(t,) for t in texts + known], "r string").select(chat_format.format_records(F.col("r")).alias("f")).select("f.*").collect()
    assert [(r.layout, r.n_turns, r.formatted) for r in found[: len(texts)]] == [(None, 0, None)] * len(texts)
    turns = [chat_format.read_back(r.formatted) for r in found[len(texts) :]]
    assert turns == [[("user", "x")], [("user", "\ufffd \U0001f600"), ("assistant", "7")], [("user", "long " * 200_000), ("assistant", "")]]


def test_conversations_with_nulls_ties_and_odd_roles(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, "user", "b", "x"), (1, None, "human", "first", "x"), (2, 0, "user", "u", "x"), (2, 1, "assistant", "a", "x"), (2, 1, "assistant", "a", "x"), (None, 0, "gpt", "long " * 50_000, "x"), (3, 0, "system", "s", "x"), (3, 1, "user", "u", "x"), (3, 2, "assistant", "a", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: chat_format.read_back(r.formatted) for r in chat_format.format_conversations(turns).collect()}
    assert got[1] == [("human", "first"), ("", ""), ("user", "b")]
    assert got[2] == [("user", "u"), ("assistant", "a"), ("assistant", "a")]
    assert got[3] == [("system", "s"), ("user", "u"), ("assistant", "a")]
    assert got[None] == [("gpt", "long " * 50_000)]
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


# URL filter


def judged(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    low = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for own, start, said in url_filter.RULES:
        if (low == own or low.endswith("." + own)) and path.startswith(start) and (best is None or len(own + start) > len(best[0])):
            best = own + start, said
    return low, path, best and best[0], best and best[1]


def test_rules(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "https://net/", "http://net", "x://example.com/de/", "http://b.example.com/de", "ftp://c.org/fr/a", "http://c.org/en", "nothing", "", None, "a://b://c.net/d", "http://evilnet/", "http://x.net?/en/", "http://É.Org/fr/" + "z" * 100_000]
    pages = spark.createDataFrame([(k, u, "pad", "pad") for k, u in enumerate(urls)] + [(1, urls[1], "pad", "pad")], "page_id bigint, url string, rule string, said string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, said = judged(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == said if said else r.verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_trees_learn_held_out_urls():
    import random

    rng = random.Random(6)

    def url(bad):
        name = "".join(rng.choice("abcdefgh") for _ in range(8))
        host = f"{'cheap-' if bad and rng.random() < 0.7 else ''}{name}{rng.randint(100, 9999) if bad else ''}.{rng.choice(['xyz', 'com'] if bad else ['org', 'com'])}"
        return f"http://{host}/{'a/' * rng.randint(0, 2)}{'?q=1&r=2' if bad and rng.random() < 0.6 else ''}", host, "/"

    rows = [(*url(k % 2), k % 2) for k in range(3000)]
    u, h, p, y = (list(x) for x in zip(*rows, strict=True))
    model = url_filter.fit(u[:2000], h[:2000], p[:2000], np.array(y[:2000], float))
    assert ((model.score(u[2000:], h[2000:], p[2000:]) >= 0.5) == np.array(y[2000:])).mean() > 0.95


def test_trees_of_one_class():
    assert url_filter.fit(["a"], ["a"], [""], np.array([1.0])).score(["b"], ["b"], [""])[0] > 0.99
    assert url_filter.fit([], [], [], np.array([])).score(["b"], ["b"], [""])[0] < 0.01


# WARC


def archive(*records, dictionary=b"GET html body " * 40):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return warc.archive_head(dictionary) + b"".join(packer.compress(r) for r in records)


def response(page, payload):
    return warc.record_bytes(page, "http://x/ é", "response", payload, hashlib.sha1(payload).hexdigest(), len(payload))


def test_frames_and_records_round_trip():
    held = [response(1, b"one"), response(2, b""), response(None, b"\r\n\r\nWARC/1.1" * 9)]
    found = list(warc.split_archive(archive(*held)))
    assert [r for _, r, _ in found] == held
    assert [warc.parse_record(r)[1:] for _, r, _ in found] == [(b"one", None), (b"", None), (b"\r\n\r\nWARC/1.1" * 9, None)]


def test_plain_dictionaries_are_read():
    raw = b"words of a raw dictionary " * 9
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    data = struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw + packer.compress(response(5, b"x"))
    assert [e for _, _, e in warc.split_archive(data)] == [None]


@pytest.mark.parametrize(
    ("change", "said"),
    [(lambda r: r.replace(b"WARC/1.1", b"WURC/1.1", 1), "version"), (lambda r: r.replace(b"WARC-Date", b"WARC-Xate", 1), "headers"), (lambda r: r.replace(b"Content-Length: 3", b"Content-Length: 4"), "length"), (lambda r: r[:-2], "length"), (lambda r: r.replace(b"one", b"two"), "digest")],
)
def test_bad_records_are_told(change, said):
    assert warc.parse_record(change(response(1, b"one")))[2].startswith(said)


def test_cut_archives_are_told():
    data = archive(response(1, b"one"), response(2, b"two" * 500))
    assert [e is None for _, _, e in warc.split_archive(data[:-3])] == [True, False]
    assert list(warc.split_archive(data + b"rubbish!!"))[-1][2].startswith("frame")


def test_long_archives_are_read_in_linear_time():
    import time

    one = archive(response(1, b"one" * 50))
    frame = one[len(warc.archive_head(b"GET html body " * 40)) :]
    took = []
    for n in (4_000, 40_000):
        began = time.time()
        assert sum(e is None for _, _, e in warc.split_archive(one + frame * (n - 1))) == n
        took.append(time.time() - began)
    assert took[1] < 30 * took[0] + 1


def test_frames_of_every_form_end_where_they_say():
    rng = random.Random(4)
    texts = [b"", b"x", b"a" * 400_000, rng.randbytes(300_000), b"ab" * 200 + rng.randbytes(70_000)]
    for level in (1, 3, 19):
        for checksum in (False, True):
            for sized in (False, True):
                packer = zstandard.ZstdCompressor(level=level, write_checksum=checksum, write_content_size=sized)
                frames = [packer.compress(t) for t in texts]
                data, at = memoryview(b"".join(frames)), 0
                for frame in frames:
                    assert warc.frame_end(data, at) == at + len(frame)
                    assert all(warc.frame_end(memoryview(frame)[:cut], 0) > cut for cut in (len(frame) - 1, len(frame) // 2))
                    at += len(frame)


URLS = ["http://x/a%2Fb?q=%26&r=%", "http://é.org/ü?x=%C3%A9", " http://x/ ", "http://x/\ta", "a\r\nb%0d", "\x85x\xa0", "", "http://x/a b"]


@pytest.mark.parametrize("url", URLS)
def test_target_uris_come_back(url):
    fields, _, wrong = warc.parse_record(warc.record_bytes(1, url, "response", b"x", hashlib.sha1(b"x").hexdigest(), 1))
    assert wrong is None and warc.target_of(fields) == url


def test_archives_with_copies_nulls_and_long_pages(spark):
    big, mid = "<p>é</p>" * 300_000, "x" * 1000
    rows = [(1, "http://a", mid, "p"), (2, None, mid, "p"), (3, "http://c", mid, "p"), (3, "http://c", mid, "p"), (4, "u", "y" * 999, "p"), (5, "u", "y" * 999, "p"), (6, "u", None, "p"), (7, "u", "", "p"), (8, "u v\r\n", big, "p"), (9, "u", big, "p"), (None, "u", mid, "p")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string")
    got = warc.archive_pages(pages).select(warc.page_number(F.col("record_id")).alias("page_id"), "type", warc.page_number(F.col("refers_to")).alias("to"), "payload_length", "payload_digest", "error", "payload", "target_uri").collect()
    last = {mid: 3, big: 9}
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        to = last.get(html or "")
        to = None if to is None or page == to else to
        want.append((page, "revisit" if to else "response", to, len(data), hashlib.sha1(data).hexdigest(), None))
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(map(repr, want))
    assert all(len(r.payload) == (0 if r.type == "revisit" else r.payload_length) for r in got)
    assert {r.target_uri for r in got if r.page_id == 8} == {"u v\r\n"}
    assert warc.archive_pages(pages.limit(0)).count() == 0
