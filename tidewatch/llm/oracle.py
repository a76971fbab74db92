"""DuckDB SQL with the same rows as the queries, where SQL can say it: it has no XXH64, CRC-32 or tokenizer, and trains nothing."""

from __future__ import annotations

from . import chat, codes, filter_audit

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""WITH docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents), items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, ws[i : i + least(10, len(ws)) - 1] AS win FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (SELECT doc_id, i, n, ws[i : i + n - 1] AS win FROM docs, lengths, unnest(range(1, greatest(len(ws) - n + 2, 1))) t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS STRING), ',' ORDER BY CAST(item_id AS STRING)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 93e-2),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
lows AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN lows ON lows.a = vec_id LEFT JOIN links ON links.a = vec_id"""

_CONTROL = "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROL)
_SAID = "</s>[INST] ok [/INST]"
CHAT = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')) t(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + 9 + CASE WHEN role = 'assistant' THEN 0 ELSE 13 END) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substring(hex, i, 1))]), '') AS bits FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

_BLANKS = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
LINES = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], {_BLANKS}), '{UPPER}', '{LOWER}') AS key FROM d, unnest(range(1, len(ls) + 1)) t(i)),
bad AS (SELECT key AS gone FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN bad ON key = gone GROUP BY r, doc_id"""


def vector_codes(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, scale: int = codes.SCALE) -> str:
    """Lloyd rounds written out, each a full scan."""
    far = "list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda r: f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(k, d * {entries} + k) AS k, min(d) AS d FROM (SELECT v.*, k, CAST({far} AS BIGINT) AS d FROM v JOIN c{r} USING (p)) GROUP BY ALL)"
    whole = "CAST(floor((s - ((s % n) + n) % n) / n) AS BIGINT)"
    steps = []
    for r in range(rounds):
        steps += [near(r), f"""m{r} AS MATERIALIZED (SELECT p, k, list({whole} ORDER BY i) AS e FROM (SELECT p, k, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY p, k, i) GROUP BY p, k),
c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{r}.e, c{r}.e) AS e FROM c{r} LEFT JOIN m{r} USING (p, k))"""]
    return f"""WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS x FROM w, unnest(range({parts})) t(p)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM w ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT p, k, x AS e FROM v JOIN f USING (vec_id)),
{", ".join(steps)}, {near(rounds)},
o AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
b AS (SELECT sha256(string_agg(CAST(e[i] AS STRING), ',' ORDER BY p, k, i)) AS codebooks_sha256 FROM c{rounds}, unnest(range(1, len(e) + 1)) t(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, b"""


def _audit() -> str:
    letters = filter_audit.FILTERS
    bit = lambda c: 1 << letters.index(c)
    fails = {
        "A": f"n < {filter_audit.MIN_WORDS}", "B": f"100 * k < {filter_audit.MIN_DISTINCT} * n", "C": f"100 * (length(t) - length(translate(t, '{UPPER}', ''))) > {filter_audit.MAX_CAPITALS} * length(t)",
        "D": f"length(translate(t, '{filter_audit.MARKS.decode()}', '')) < length(t)", "E": "coalesce(doc_id > first, false)",
    }
    mask = " + ".join(f"CASE WHEN {c} THEN {bit(x)} ELSE 0 END" for x, c in fails.items())
    count = lambda c: f"CAST(coalesce(sum(n) FILTER ({c}), 0) AS BIGINT)"
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT doc_id, part, t, len(ws) AS n, len(list_distinct(ws)) AS k, min(doc_id) OVER (PARTITION BY t) AS first FROM w),
m AS MATERIALIZED (SELECT part, {mask} AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM x LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES {", ".join(f"('{x}', {bit(x)})" for x in letters)}) t(letter, bit)),
o AS (SELECT '' AS o, 0 AS gone, 0 AS was, 0 AS bit UNION ALL SELECT o.o || letter, gone + f.bit, gone, f.bit FROM o JOIN f ON gone & f.bit = 0),
s AS MATERIALIZED (SELECT a.o AS filter_order, CAST(length(b.o) AS INTEGER) AS step, b.gone, b.was, b.bit FROM o a JOIN o b ON length(a.o) = {len(letters)} AND length(b.o) > 0 AND starts_with(a.o, b.o)),
g AS (SELECT part, filter_order, step, bit, {count("mask & gone = 0")} AS kept, {count("mask & was = 0 AND mask & bit > 0")} AS removed, {count("mask & was > 0 AND mask & bit > 0")} AS redundant, {count("mask = bit")} AS unique_fails,
  {count("mask & was = 0 AND mask & bit > 0 AND good = 1")} AS good_lost, {count("mask & was = 0 AND mask & bit > 0 AND toxic = 1")} AS toxic_lost FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g"""


SQL = {"op2_decontamination": DECONTAMINATION, "op3_embedding_dedup": EMBEDDINGS, "op5_chat_format": CHAT, "op9_warc": WARC, "op11_line_dedup": LINES, "op12_vector_codes": vector_codes(), "op13_filter_audit": _audit()}
