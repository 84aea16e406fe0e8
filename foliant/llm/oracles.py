"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re

from foliant.llm.chat_format import CONTROL, END, START
from foliant.llm.decontam import SPAN, SUBSTITUTIONS, WINDOW
from foliant.llm.mixing import LARGEST_BLOCK, LEAST_BLOCK, SLOTS
from foliant.llm.quality_rules import RULES, STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def quality_sql(source: str = "documents", select: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    stop = [w + end for w in (*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)) for end in ("", ",", ".")]
    ratio = {
        "mean_word_chars": "word_chars / greatest(n_words, 1)", "symbols_per_word": "n_symbols / greatest(n_words, 1)", "stop_word_ratio": "n_stop / greatest(n_words, 1)",
        "stutter_ratio": "n_stutter / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "capital_ratio": "n_capitals / greatest(word_chars, 1)", "shout_ratio": "n_shouts / greatest(n_words, 1)",
    }
    rules = " AND ".join(f"{ratio[r.measure]} {op} {bound}" for r in RULES for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)
    return rf"""
WITH q_base AS (SELECT *, coalesce(text, '') AS q_text, {WORDS} AS q_words, row_number() OVER () AS q_row FROM {source}),
q_windows AS (SELECT q_row, i, array_to_string(q_words[i:i + 7], ' ') AS w FROM (SELECT q_row, q_words, unnest(range(1, len(q_words) - 6)) AS i FROM q_base)),
q_twice AS (SELECT q_row, unnest(list(i)) AS i FROM q_windows GROUP BY q_row, w HAVING count(*) > 1),
q_covered AS (SELECT q_row, count(DISTINCT p) AS n FROM (SELECT q_row, unnest(range(i, i + 8)) AS p FROM q_twice) GROUP BY q_row),
q_lines AS (SELECT q_row, unnest(string_split(q_text, chr(10))) AS line FROM q_base),
q_line_counts AS (SELECT q_row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM q_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY q_row),
q_counts AS (
  SELECT b.*, len(q_words)::BIGINT AS n_words, length(array_to_string(q_words, ''))::BIGINT AS word_chars,
    length(regexp_replace(q_text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(list_filter(q_words, lambda x: x IN ({_quoted(stop)}))) AS n_stop,
    len(list_filter(range(2, len(q_words) + 1), lambda i: q_words[i] = q_words[i - 1])) AS n_stutter,
    length(regexp_replace(q_text, '[^A-Z]', '', 'g')) AS n_capitals, (length(q_text) - length(replace(q_text, '!!', ''))) // 2 AS n_shouts
  FROM q_base b LEFT JOIN q_covered c USING (q_row) LEFT JOIN q_line_counts l USING (q_row)),
q_judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM q_counts),
q_verdict AS (SELECT *, NOT base_failed AND {rules} AS kept FROM q_judged)
SELECT {select} FROM q_verdict"""


def mixing_sql(source: str = "documents", select: str = "doc_id, size, source_size, target, taken, first_slot") -> str:
    return rf"""
WITH m_sized AS (SELECT *, row_number() OVER () AS m_row, len({WORDS})::BIGINT AS size, md5('mix-' || coalesce(doc_id::VARCHAR, '')) AS place FROM {source}),
m_sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM m_sized GROUP BY source),
m_caps AS (SELECT *, [3, 1, 2][((nth - 1) % 3 + 1)::BIGINT] AS weight, 2 * source_size AS cap FROM m_sources),
m_levels AS (
  SELECT *, cap / weight AS ratio, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM m_caps),
m_targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM m_levels WHERE level <= ratio ORDER BY ratio, nth LIMIT 1) * weight, cap::DOUBLE)) AS target FROM m_levels),
m_lines AS (SELECT s.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM m_sized s JOIN m_targets t ON s.source IS NOT DISTINCT FROM t.source),
m_block AS (SELECT greatest({LEAST_BLOCK}, least({LARGEST_BLOCK}, ceil(coalesce(floor(sum(target)), 0) / {SLOTS})))::BIGINT AS b FROM m_targets),
m_due AS (SELECT source, due, (sum(due) OVER (ORDER BY source IS NOT NULL, source) - due)::BIGINT AS low, (sum(due) OVER ())::BIGINT AS n
  FROM (SELECT source, ceil(floor(target) / b)::BIGINT AS due FROM m_targets, m_block) WHERE due > 0),
m_points AS (SELECT source, unnest(range(low, low + due)) AS v, greatest(1, length(ltrim(bin(n - 1), '0'))) AS bits FROM m_due),
m_slots AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM (SELECT source, ('0b' || reverse(lpad(bin(v), bits::INTEGER, '0')))::BIGINT AS slot FROM m_points)),
m_laid AS (SELECT m_row, source, start + pass * source_size AS a, least(start + pass * source_size + size, floor(target))::BIGINT AS z FROM m_lines, (VALUES (0), (1)) AS p(pass) WHERE size > 0),
m_pieces AS (SELECT m_row, source, a, z, b, unnest(range(a // b, (z - 1) // b + 1)) AS rank FROM m_laid, m_block WHERE a < z),
m_used AS (SELECT m_row, sum(least(z, (p.rank + 1) * b) - greatest(a, p.rank * b))::BIGINT AS taken, min(slot) AS first_slot
  FROM m_pieces p JOIN m_slots s ON p.rank = s.rank AND p.source IS NOT DISTINCT FROM s.source GROUP BY m_row),
m_taken AS (SELECT l.*, coalesce(u.taken, 0)::BIGINT AS taken, u.first_slot FROM m_lines l LEFT JOIN m_used u USING (m_row))
SELECT {select} FROM m_taken"""


def chat_sql() -> str:
    control = "|".join(re.escape(c) for c in CONTROL)
    count = lambda c, what: f"len(regexp_extract_all({c}, '{what}'))"
    longer = lambda c: f"length({c}) + {count(c, chr(92) * 2)} + {count(f'replace({c}, chr(92), chr(92) || chr(92))', control)}"
    return rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
  sum({len(START) + len(END) + 1} + {longer("role")} + {count("role", chr(92) + "n")} + {longer("text")})::BIGINT AS formatted_chars FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole"""


def line_sql(source: str = "documents", select: str = "doc_id, len(all_lines)::BIGINT AS n_lines, (len(all_lines) - len(kept_lines))::BIGINT AS n_dropped, sha256(array_to_string(kept_lines, chr(10))) AS kept_sha256") -> str:
    return rf"""
WITH l_rows AS (SELECT *, row_number() OVER () AS l_row, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM {source}),
l_lines AS (SELECT l_row, doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS i FROM l_rows),
l_keys AS (SELECT *, translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l_lines),
l_heavy AS (SELECT key, max(doc_id) AS last_doc FROM l_keys WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT l_row) >= 3),
l_kept AS (SELECT l_row, list(line ORDER BY i) AS kept_lines FROM l_keys LEFT JOIN l_heavy USING (key) WHERE NOT coalesce(doc_id < last_doc, false) GROUP BY l_row),
l_done AS (SELECT r.*, coalesce(kept_lines, []) AS kept_lines FROM l_rows r LEFT JOIN l_kept USING (l_row))
SELECT {select} FROM l_done"""


def jaccard_sql(source: str = "documents", select: str = "doc_id, n_shingles, component_id, n_links") -> str:
    """Links of whole sets by counted common shingles, and components by reachability."""
    return rf"""
WITH RECURSIVE j_words AS (SELECT *, row_number() OVER () AS j_row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
j_sets AS (SELECT * EXCLUDE (w), CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS shingles FROM j_words),
j_rows AS (SELECT * EXCLUDE (shingles), len(shingles)::BIGINT AS n_shingles, CASE WHEN len(shingles) > 0 THEN md5(array_to_string(shingles, chr(10))) END AS sig, shingles FROM j_sets),
j_classes AS (SELECT sig, any_value(n_shingles) AS n, min(doc_id) AS rep, any_value(shingles) AS shingles FROM j_rows WHERE sig IS NOT NULL GROUP BY sig),
j_tokens AS (SELECT sig, n, unnest(shingles) AS token FROM j_classes),
j_links AS (SELECT x.sig AS a, y.sig AS b FROM j_tokens x JOIN j_tokens y ON x.token = y.token AND x.sig <> y.sig AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.sig, y.sig HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
j_reach AS (SELECT sig, sig AS other FROM j_classes UNION SELECT r.sig, l.b FROM j_reach r JOIN j_links l ON r.other = l.a),
j_least AS (SELECT r.sig, min(rep) AS component_id FROM j_reach r JOIN j_classes c ON r.other = c.sig GROUP BY r.sig),
j_degree AS (SELECT a AS sig, count(*)::BIGINT AS n_links FROM j_links GROUP BY a),
j_done AS (SELECT r.*, coalesce(l.component_id, doc_id) AS component_id, coalesce(d.n_links, 0)::BIGINT AS n_links FROM j_rows r LEFT JOIN j_least l ON r.sig = l.sig LEFT JOIN j_degree d ON r.sig = d.sig)
SELECT {select} FROM j_done"""


def decontam_sql(source: str = "documents", select: str = "doc_id, item_id, matched_words, item_words, first_word") -> str:
    """All alignments of a document and an item, by counted equal words; those with enough of them in a window."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+')"
    least = WINDOW - SUBSTITUTIONS
    return rf"""
WITH b_items AS (SELECT item_id, row_number() OVER () AS b_item, {words} AS w FROM benchmark),
b_words AS (SELECT item_id, b_item, len(w)::BIGINT AS m, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS spot FROM b_items),
b_docs AS (SELECT *, row_number() OVER () AS b_row, {words} AS w FROM {source}),
b_places AS (SELECT * FROM (SELECT b_row, len(w)::BIGINT AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM b_docs) WHERE word IN (SELECT word FROM b_words)),
b_aligned AS (SELECT b_row, b_item, place - spot AS shift, any_value(item_id) AS item_id, any_value(m) AS m, any_value(n) AS n, list(spot ORDER BY spot) AS hits
  FROM b_places JOIN b_words USING (word) GROUP BY b_row, b_item, place - spot HAVING count(*) >= least({least}, any_value(m) - (any_value(m) >= {SPAN})::INT)),
b_found AS (SELECT *, len(hits)::BIGINT AS matched_words, greatest(shift, 0)::BIGINT AS first_word FROM b_aligned
  WHERE least(m, n - shift) - greatest(0, -shift) >= least({WINDOW}, m)
    AND CASE WHEN m < {WINDOW} THEN len(hits) >= m - (m >= {SPAN})::INT ELSE len(list_filter(range(1, len(hits) - {least - 2}), lambda k: hits[k + {least - 1}] - hits[k] < {WINDOW})) > 0 END),
b_best AS (SELECT * FROM b_found QUALIFY row_number() OVER (PARTITION BY b_row, b_item ORDER BY matched_words DESC, first_word) = 1),
b_done AS (SELECT d.* EXCLUDE (w), f.item_id, f.matched_words, f.m AS item_words, f.first_word FROM b_docs d LEFT JOIN b_best f USING (b_row))
SELECT {select} FROM b_done"""


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text; ``crc_table`` must be in scope as a table of one row, ``t``."""
    return f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])))"


CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""


def repair_sql() -> str:
    """Repairs from the last row to the first: of every state of the grammar the least (cost, edits) and the rows they give."""
    best = lambda options: f"list_sort([{', '.join(options)}])[1]"
    end = "{'c': %s, 'a': %s, 'r': %s}"
    far = end % (1 << 40, "''", "[]::VARCHAR[]")
    to_role = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def then(state: int, cost: str, label: str, line: str) -> str:
        return end % (f"v[{state + 1}].c + {cost}", f"'{label}' || v[{state + 1}].a", f"list_concat({line}, v[{state + 1}].r)")

    def consumed(state: int, before: str, lines: str, cost: int) -> list[str]:
        """Options that read the row, after the insertions ``before`` that put out ``lines``."""
        role, to = to_role[state]
        out = [then(state, f"{cost} + 4", before + "D", lines)]
        out.append(f"CASE WHEN fault < 2 THEN {then(to, f'{cost} + 3 + 3 * fault', before + 'R', f'list_concat({lines}, [{chr(39)}{role}:{chr(39)} || text])')} ELSE {far} END")
        for initial, kept_to in keeps[state].items():
            out.append(f"CASE WHEN fault < 2 AND left(role, 1) = '{initial}' THEN {then(kept_to, f'{cost} + 3 * fault', before + 'K', f'list_concat({lines}, [role || {chr(39)}:{chr(39)} || text])')} ELSE {far} END")
        return out

    def options(state: int) -> list[str]:
        out, at, lines, before = [], state, [], ""
        for inserted in range(3):
            out += consumed(at, before, f"[{', '.join(lines)}]::VARCHAR[]", 3 * inserted)
            role, at = to_role[at]
            lines, before = [*lines, f"'{role}:'"], before + "I"
        return out

    states = ", ".join(best(options(s)) for s in range(4))
    closed = ", ".join(end % x for x in ((0, "''", "[]::VARCHAR[]"), (6, "'II'", "['user:', 'assistant:']"), (3, "'I'", "['assistant:']"), (0, "''", "[]::VARCHAR[]")))
    return rf"""
WITH RECURSIVE {CRC_TABLE},
r_dealt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS dealt FROM conversations, crc_table),
r_rows AS (SELECT conv_id, turn, CASE WHEN dealt = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN dealt = 1 THEN '' WHEN dealt = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE dealt WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM r_dealt)),
r_placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || chr(0) || text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM r_rows),
r_seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS time, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS closing,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM r_placed),
r_faults AS (SELECT *, CASE WHEN closing = '' THEN 'blank' WHEN time > 1 THEN 'duplicate' WHEN closing NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind FROM r_seen),
r_marked AS (SELECT *, CASE kind WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS fault FROM r_faults),
r_steps AS (
  SELECT DISTINCT conv_id, n AS i, [{closed}] AS v FROM r_marked
  UNION ALL SELECT m.conv_id, m.i - 1, [{states}] FROM r_steps s JOIN r_marked m ON s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.i = m.i),
r_counts AS (SELECT conv_id, (max(turn) - min(turn) + 1 - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
  count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r_marked GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN r_counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN r_steps s ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = 0"""


def leaderboard_sql() -> str:
    """Running revenue on the dense grid of a nation's items and arrival days."""
    key = " || ',' || ".join(f"coalesce({c}::VARCHAR, '')" for c in ("sale_id", "item_id", "vendor_id", "line_no"))
    return rf"""
WITH {CRC_TABLE},
b_keyed AS (SELECT *, {crc_sql(key)} AS h FROM sale_lines, crc_table),
b_days AS (SELECT *, coalesce(shipped_at::DATE - DATE '1970-01-01', 19723 + h % 150)::BIGINT AS s FROM b_keyed),
b_arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM b_days),
b_dealt AS (SELECT *, least(10, 1 + floor((a - 19723) * 10 / 180.0))::INT AS batch FROM b_arrived),
b_newest AS (SELECT batch, max(s) AS newest FROM b_dealt GROUP BY batch),
b_floor AS (SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM b_newest),
b_lines AS (
  SELECT v.nation_id, d.item_id, d.a, d.batch,
    CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0) AS cents
  FROM b_dealt d JOIN b_floor f ON d.batch = f.batch AND NOT coalesce(d.s + 3 < f.newest, false)
    JOIN vendors v ON d.vendor_id = v.vendor_id AND v.nation_id IS NOT NULL JOIN items i ON d.item_id = i.item_id),
b_sums AS (SELECT nation_id, item_id, a, sum(cents)::BIGINT AS cents FROM b_lines GROUP BY ALL),
b_grid AS (SELECT d.nation_id, d.a, d.batch, i.item_id FROM (SELECT nation_id, a, any_value(batch) AS batch FROM b_lines GROUP BY nation_id, a) d JOIN (SELECT DISTINCT nation_id, item_id FROM b_lines) i USING (nation_id)),
b_running AS (SELECT g.*, sum(coalesce(cents, 0)) OVER (PARTITION BY nation_id, item_id ORDER BY a)::BIGINT AS revenue FROM b_grid g LEFT JOIN b_sums USING (nation_id, item_id, a)),
b_ranked AS (SELECT *, row_number() OVER (PARTITION BY nation_id, a ORDER BY revenue <= 0, revenue DESC, item_id) AS place FROM b_running),
b_ranks AS (SELECT *, CASE WHEN revenue > 0 AND place <= 10 THEN place::INT END AS new_rank FROM b_ranked),
b_both AS (SELECT *, lag(new_rank) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS old_rank FROM b_ranks)
SELECT nation_id, a AS arrival_day, item_id, batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change, old_rank, new_rank, revenue
FROM b_both WHERE old_rank IS DISTINCT FROM new_rank"""


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT html, max(page_id) AS last FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN d ON p.html = d.html"""


ORACLES: dict[str, str] = {
    "op1_chat_format": chat_sql(),
    "op3_warc": WARC_SQL,
    "op5_quality_rules": quality_sql(),
    "op7_line_dedup": line_sql(),
    "op8_decontam": decontam_sql() + " WHERE matched_words IS NOT NULL",
    "op9_jaccard_join": jaccard_sql(),
    "op10_mixing": mixing_sql(),
    "op11_leaderboard": leaderboard_sql(),
    "op13_conversation_repair": repair_sql(),
}


def pipeline_sql() -> str:
    """The five stages, each over what the one before it keeps."""
    own = "doc_id, text, lang, source, n_chars"
    cut = "CASE WHEN len(kept_lines) < len(all_lines) THEN array_to_string(kept_lines, chr(10)) ELSE text END"
    return f"""
WITH s_good AS (SELECT {own} FROM ({quality_sql(select=f"{own}, kept")}) WHERE kept),
s_lines AS ({line_sql("s_good", f"doc_id, {cut} AS text, lang, source, length({cut})::BIGINT AS n_chars")}),
s_near AS (SELECT {own} FROM ({jaccard_sql("s_lines", f"{own}, sig, component_id")}) QUALIFY sig IS NULL OR row_number() OVER (PARTITION BY sig IS NULL, component_id ORDER BY doc_id, sig) = 1),
s_clean AS (SELECT {own} FROM ({decontam_sql("s_near", f"{own}, matched_words")}) WHERE matched_words IS NULL)
SELECT * FROM ({mixing_sql("s_clean", f"{own}, size, target, taken, first_slot")})"""
