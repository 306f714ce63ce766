"""DuckDB SQL of the corpus queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH = r"regexp_extract_all(coalesce({t}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(t=_LOWER.format(t="text"))
_EMPTY = "CAST([] AS VARCHAR[])"

OP3 = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  translate(""" + " || ".join(f"to_base(CAST('0x' || substr(s, {1 + 10 * i}, 10) AS BIGINT), 32, 8)" for i in range(4)) + r""", '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM d"""

OP6 = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_BENCH} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP7 = f"""WITH d AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents),
x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i : i + 19], ' ') ORDER BY doc_id, i) AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM x WHERE r > 1), l AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda y, j: NOT list_contains(ps, j)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)"""

OP8 = r"""WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS t, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS l, string_agg(role[1], '' ORDER BY turn) AS s,
  sum(len('### : ') + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 ELSE 9 END + len(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '#', '&num;')) + len(' </turn>') + 1) AS f FROM r GROUP BY 1)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, CAST(len(l) AS BIGINT) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars, regexp_full_match(s, 's?(ua)*(ua|u)') AS valid FROM a"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(t=_LOWER.format(t='text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id"""



def _op12() -> str:
    """Forward over the rows of all conversations at once: each state holds the least string of (cost, audit, sign 1, repaired text)."""
    def edit(x: str, letter: str, cost: str, out: str = "''") -> str:
        at = f"instr({x}, chr(1))"
        return f"(lpad(CAST(CAST(left({x}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10, {at} - 10) || '{letter}' || substr({x}, {at}) || {out})"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    insert = lambda x, role: edit(x, "I", "5", role)
    once = f"least(s2, {insert('s0', user)}, {insert('s1', user)}, {insert('s3', user)}) AS t2, least(s3, {insert('s2', assistant)}) AS t3"
    twice = f"least(t2, {insert('t3', user)}) AS u2, least(t3, {insert('t2', assistant)}) AS u3"

    kept = "chr(10) || role || ':' || text"

    def stay(x: str, letter: str, role: str) -> str:
        keep, other = edit(x, "K", "extra", kept), edit(x, "R", "(1 + extra)", f"chr(10) || '{role}:' || text")
        return f"CASE WHEN fault < 2 THEN NULL WHEN letter = '{letter}' THEN {keep} ELSE {other} END"

    first = f"CASE WHEN fault >= 2 AND letter = 's' THEN {edit('s0', 'K', 'extra', kept)} END"
    step = ", ".join((
        f"{edit('s0', 'D', '2')} AS s0", f"least({edit('s1', 'D', '2')}, {first}) AS s1",
        f"least({edit('u2', 'D', '2')}, {stay('s0', 'u', 'user')}, {stay('s1', 'u', 'user')}, {stay('u3', 'u', 'user')}) AS s2",
        f"least({edit('u3', 'D', '2')}, {stay('u2', 'a', 'assistant')}) AS s3"))
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda z: CAST(ord(z) AS BIGINT))), lambda c, b: {byte}), 4294967295) % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS letter, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS z, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, CASE WHEN z = '' THEN 0 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 1 WHEN z NOT IN ('.', '!', '?') THEN 2 ELSE 3 END AS fault, lead(letter) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM o),
g AS (SELECT *, CASE fault WHEN 2 THEN 5 ELSE 0 END AS extra FROM f),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 0) AS blank, count(*) FILTER (WHERE fault = 1) AS duplicate, count(*) FILTER (WHERE fault = 2) AS truncated,
  count(*) FILTER (WHERE after IS NOT NULL AND letter || after NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM g GROUP BY conv_id),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' || chr(1) AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM n
  UNION ALL SELECT conv_id, i, {step} FROM (SELECT *, {twice} FROM (SELECT w.conv_id, g.i, s0, s1, s2, s3, {once}, role, text, letter, fault, extra FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = w.i + 1) a) b),
e AS (SELECT conv_id, least(s0, u3) AS x FROM (SELECT *, {twice} FROM (SELECT w.*, {once} FROM w JOIN n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.i = n.rows) a) b)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(x, 9) AS BIGINT), 0) AS cost,
  coalesce(substr(x, 10, instr(x, chr(1)) - 10), '') AS audit, sha256(coalesce(substr(x, instr(x, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES = {
    "op3_warc": OP3, "op6_benchmark_decontamination": OP6, "op7_substring_dedup": OP7, "op8_chat_formatting": OP8, "op9_ngram_jaccard_join": OP9,
    "op12_conversation_repair": _op12()}
