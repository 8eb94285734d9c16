"""SQL that states the results of training-data queries independently, where SQL can.

There is none for fingerprints, packing and language (op1, op2, op7), for the mix (op4 shuffles by a
hash the checking engine lacks) and for the licence rules (op10); tests hold those against plain
versions.
"""

from __future__ import annotations

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(COALESCE(text, ''), '{LETTERS}', '{LETTERS.lower()}')"
WORD = r"[^\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SAID = "<|im_end|><|im_start|>assistant ok"


def _escaped(column: str) -> str:
    return rf"replace(replace({column}, '\', '\\'), '<|', '<\|')"


CHAT = rf"""WITH said AS (
    SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'),
shown AS (SELECT *, '<|im_start|>' || replace({_escaped("role")}, chr(10), '\n') || chr(10) || {_escaped("text")} || '<|im_end|>' || chr(10) AS turn_text FROM said)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, turn_text)) AS turns_sha256,
    CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(COALESCE(string_agg(text, '' ORDER BY turn, turn_text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(SUM(length(turn_text)) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id"""

LINES = rf"""WITH lines AS (
    SELECT doc_id, unnest(range(1, len(parts) + 1)) AS place, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
worded AS (SELECT *, length(line) AS n FROM lines WHERE regexp_matches(line, '{HAS_WORD}')),
firsts AS (SELECT line, n, MIN((doc_id, place)) AS first FROM worded GROUP BY line, n),
long AS (SELECT * FROM firsts WHERE n >= 20),
ends AS (
    SELECT line, n, first, m, 0 AS side, left(line, m // 2) AS half FROM (SELECT *, unnest([n, n - 1]) AS m FROM long)
    UNION ALL SELECT line, n, first, m, 1, right(line, m - m // 2) FROM (SELECT *, unnest([n, n - 1]) AS m FROM long)),
pairs AS (
    SELECT DISTINCT a.line AS a, a.first AS a_first, a.n AS m, b.line AS b, b.first AS b_first, b.n AS n
    FROM ends a JOIN ends b ON a.m = b.m AND a.side = b.side AND a.half = b.half WHERE a.line <> b.line AND b.n - a.n IN (0, 1)),
near AS (
    SELECT * FROM pairs WHERE len(list_filter(range(1, m + 2), lambda i: left(a, i - 1) = left(b, i - 1)
        AND substr(a, CAST(i + 1 - (n - m) AS BIGINT)) = substr(b, i + 1))) > 0),
going AS (SELECT b AS line FROM near WHERE a_first < b_first UNION SELECT a FROM near WHERE b_first < a_first),
gone AS (
    SELECT w.doc_id, w.place FROM worded w JOIN firsts f ON f.line = w.line LEFT JOIN going g ON g.line = w.line
    WHERE g.line IS NOT NULL OR f.first <> (w.doc_id, w.place)),
kept AS (
    SELECT l.doc_id, COALESCE(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '') AS text, COUNT(g.place) AS n_removed
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place GROUP BY 1),
counts AS (SELECT doc_id, COUNT(*) AS n_lines FROM worded GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN k.text END AS text, COALESCE(c.n_lines, 0) AS n_lines, COALESCE(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)"""

QUALITY = rf"""WITH read AS (
    SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS words,
        list_filter(string_split(COALESCE(text, ''), chr(10)), lambda l: regexp_matches(l, '{HAS_WORD}')) AS lines FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM read),
windows AS (
    SELECT doc_id, place, [word, LEAD(word, 1) OVER w, LEAD(word, 2) OVER w] AS trio, LEAD(word, 2) OVER w AS third FROM placed
    WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
again AS (SELECT doc_id, place, COUNT(*) OVER (PARTITION BY doc_id, trio) AS times FROM windows WHERE third IS NOT NULL),
covered AS (SELECT doc_id, COUNT(DISTINCT place + step) AS n FROM again, (SELECT unnest([0, 1, 2]) AS step) WHERE times > 1 GROUP BY 1),
most AS (SELECT doc_id, MAX(n) AS n FROM (SELECT doc_id, word, COUNT(*) AS n FROM placed GROUP BY 1, 2) GROUP BY 1),
measured AS (
    SELECT r.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(COALESCE(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, COALESCE(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(list_filter(words, lambda w: regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]'))) AS loud,
        len(list_filter(words, lambda w: regexp_matches(w, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS lettered, COALESCE(m.n, 0) AS most,
        len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS cut
    FROM read r LEFT JOIN covered c USING (doc_id) LEFT JOIN most m USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR word_chars NOT BETWEEN 3 * n_words AND 10 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
        OR 2 * loud > n_words OR 10 * lettered < 7 * n_words OR 10 * most > 3 * n_words OR 10 * cut > 3 * n_lines) AS kept
FROM based"""

LINKED = rf"""WITH RECURSIVE read AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS words FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1),
        lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM read),
sized AS (SELECT doc_id, len(shingles) AS n, shingles FROM sets),
held AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM sized),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS m, b.n AS n, COUNT(*) AS common FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    WHERE 85 * greatest(a.n, b.n) <= 100 * least(a.n, b.n) GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (m + n - common)),
reached AS (SELECT doc_id, doc_id AS root FROM sized UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, MIN(r.root) AS component_id FROM sized s JOIN reached r USING (doc_id) GROUP BY 1, 2"""

CAPTURES = r"""WITH paid AS (
    SELECT page_id, url, COALESCE(html, '') AS html, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
kept AS (SELECT payload_digest, MAX(page_id) AS keeper FROM paid WHERE payload_bytes >= 1000 GROUP BY 1),
typed AS (
    SELECT p.*, k.keeper, k.keeper IS NOT NULL AND p.payload_bytes >= 1000 AND p.page_id <> k.keeper AS again,
        regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]*)', 1)), '^www\.', '') AS host,
        regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
        strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
    FROM paid p LEFT JOIN kept k USING (payload_digest)),
keyed AS (
    SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
        || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key FROM typed)
SELECT url_key, captured_at, page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN keeper END AS refers_to, ROW_NUMBER() OVER (ORDER BY url_key, captured_at, page_id) - 1 AS position FROM keyed"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    start = f"[CAST(4294967295 AS BIGINT)] || list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce({start}, lambda c, b: {bits}), 4294967295)"


def _cheapest() -> str:
    """The four best (cost, audit) after a row, from those before it: by trying all edits with up to two insertions."""
    given = [2, 2, 3, 2]
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    ways: list[list[str]] = [[] for _ in range(4)]
    for start in range(4):
        state = start
        for inserts in range(3):
            audit = "I" * inserts
            ways[state].append(_way(start, f"{3 * inserts + 4}", audit + "D"))
            ways[given[state]].append(_way(start, f"{3 * inserts + 3} + extra", audit + "R"))
            for (of, initial), after in kept.items():
                if of == state:
                    ways[after].append(_way(start, f"{3 * inserts} + extra + CASE WHEN initial = '{initial}' THEN 0 ELSE 1000000 END", audit + "K"))
            state = given[state]
    return "[" + ", ".join(f"list_min([{', '.join(each)}])" for each in ways) + "]"


def _way(start: int, cost: str, audit: str) -> str:
    return f"{{'c': v[{start + 1}].c + {cost}, 'a': v[{start + 1}].a || '{audit}'}}"


BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
REPAIR = rf"""WITH RECURSIVE said AS (
    SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
        COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
struck AS (SELECT *, {_crc32("name")} % 20 AS damage FROM said),
harmed AS (
    SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN damage = 1 THEN '' WHEN damage = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy FROM struck WHERE damage <> 0),
told AS (
    SELECT *, rtrim(text, {BLANKS}) AS held, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text) AS key FROM harmed),
placed AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key, copy) AS i,
        ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM told),
faulty AS (
    SELECT conv_id, i, turn, role, text, left(role, 1) AS initial, held = '' AS blank, held <> '' AND again > 1 AS duplicate,
        held <> '' AND again = 1 AND right(held, 1) NOT IN ('.', '!', '?') AS truncated,
        COALESCE(LAG(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au'), FALSE) AS illegal FROM placed
    WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
priced AS (SELECT *, CASE WHEN blank OR duplicate THEN 1000000 WHEN truncated THEN 3 ELSE 0 END AS extra FROM faulty),
walk AS (
    SELECT conv_id, 0 AS i, [{{'c': 0, 'a': ''}}, {{'c': 1000000, 'a': ''}}, {{'c': 1000000, 'a': ''}}, {{'c': 1000000, 'a': ''}}] AS v
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT w.conv_id, w.i + 1, {_cheapest()} FROM walk w JOIN priced p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i + 1),
ended AS (
    SELECT conv_id, arg_max(list_min([v[1], {{'c': v[2].c + 6, 'a': v[2].a || 'II'}}, {{'c': v[3].c + 3, 'a': v[3].a || 'I'}}, v[4]]), i) AS best
    FROM walk GROUP BY conv_id),
done AS (
    SELECT conv_id, best.c AS cost, best.a AS audit, 0 AS step, 0 AS i, 0 AS state, CAST(NULL AS VARCHAR) AS line FROM ended
    UNION ALL
    SELECT d.conv_id, d.cost, d.audit, d.step + 1, CASE WHEN e.edit = 'I' THEN d.i ELSE d.i + 1 END,
        CASE WHEN e.edit = 'D' THEN d.state WHEN e.edit = 'K' THEN instr('sua', p.initial) WHEN d.state = 2 THEN 3 ELSE 2 END,
        CASE e.edit WHEN 'D' THEN NULL WHEN 'K' THEN p.role || ':' || p.text
            ELSE CASE WHEN d.state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e.edit = 'R' THEN p.text ELSE '' END END
    FROM done d JOIN (SELECT conv_id AS owner, unnest(range(1, length(best.a) + 1)) AS step, unnest(string_split(best.a, '')) AS edit FROM ended) e
        ON e.owner IS NOT DISTINCT FROM d.conv_id AND e.step = d.step + 1
    LEFT JOIN priced p ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.i = d.i + 1),
texts AS (SELECT conv_id, any_value(cost) AS cost, any_value(audit) AS audit, sha256(COALESCE(string_agg(line, chr(10) ORDER BY step), '')) AS repaired_sha256 FROM done GROUP BY conv_id),
counts AS (
    SELECT conv_id, COALESCE(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (WHERE blank) AS blank,
        COUNT(*) FILTER (WHERE duplicate) AS duplicate, COUNT(*) FILTER (WHERE truncated) AS truncated, COUNT(*) FILTER (WHERE illegal) AS illegal
    FROM faulty GROUP BY conv_id)
SELECT t.conv_id, CAST(COALESCE(gaps, 0) AS BIGINT) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate,
    COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, repaired_sha256
FROM texts t LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM t.conv_id"""

TRIE = rf"""WITH lists AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS turns
    FROM (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
taking AS (SELECT *, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM lists),
rebuilt AS (
    SELECT t.conv_id, COALESCE(b.turns[1:t.h], []) || t.turns[t.h + 1:] AS turns FROM taking t LEFT JOIN lists b ON b.conv_id = t.conv_id - t.conv_id % 100),
begun AS (SELECT conv_id, len(turns) AS n, d AS depth, turns[1:d] AS path FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT depth, path, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].text) END AS chars,
        sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM begun GROUP BY depth, path),
children AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, COUNT(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
told AS (SELECT n.*, COALESCE(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path),
under AS (SELECT *, unnest(range(depth + 1)) AS above FROM told),
sums AS (
    SELECT above, path[1:above] AS path, COUNT(*) FILTER (WHERE n_children = 0) AS n_leaves, SUM((n_convs - 1) * chars) AS saved FROM under GROUP BY 1, 2)
SELECT t.conv_id, CAST(t.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, t.ends_sha256
FROM told t JOIN sums s ON s.above = t.depth AND s.path = t.path LEFT JOIN nodes p ON p.depth = t.depth - 1 AND p.path = t.path[1:t.depth - 1]"""

SQL: dict[str, str] = {
    "op3_chat_formatting": CHAT,
    "op5_line_dedup": LINES,
    "op6_quality_cascade": QUALITY,
    "op8_jaccard_join": LINKED,
    "op9_warc_histories": CAPTURES,
    "op11_prefix_trie": TRIE,
    "op12_conversation_repair": REPAIR,
}
