"""DuckDB SQL over whole tables for the queries that have a form there: near-duplicates, secret scans, spelling variants,
conversation repair. Each statement goes a plain way of its own to the result: exact similarities of all texts that share
a shingle, matches cut out one after the other, pairs of words by shared deletions, and a table over rows and states for
the edits."""

from __future__ import annotations

#: The kinds' patterns with the group that counts, and its least length; the last kind is the added one.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 6), ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24), ("token", "([A-Za-z0-9+/_-]+)", 28)]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes, four bits at a time, the lower ones first."""
    digits = f"flatten(list_transform(range(1, length(hex(encode({text}))), 2), lambda k: [substr(hex(encode({text})), k + 1, 1), substr(hex(encode({text})), k, 1)]))"
    numbers = f"list_transform({digits}, lambda d: (strpos('0123456789ABCDEF', d) - 1)::BIGINT)"
    low = "xor(c, d)"
    bits = f"xor(xor(({low} & 1) * 498536548, (({low} >> 1) & 1) * 997073096), xor((({low} >> 2) & 1) * 1994146192, (({low} >> 3) & 1) * 3988292384))"
    return f"xor(list_reduce({numbers}, lambda c, d: xor(c >> 4, {bits}), 4294967295::BIGINT), 4294967295)"


def _matches(place: int, pattern: str, least: int) -> str:
    """Matches of one kind with what lies before each: a lazy beginning ends where the next match starts."""
    cut = _quoted(f"((?s:.)*?)({pattern})")
    groups = ", ".join(f"regexp_extract_all(text, {cut}, {g}) AS {name}" for g, name in ((1, "gaps"), (2, "wholes"), (3, "held")))
    one = "unnest(gaps) AS gap, unnest(wholes) AS whole, unnest(held) AS value, generate_subscripts(gaps, 1) AS k"
    return f"SELECT r, repo, owner, {place} AS place, {least} AS least, {one} FROM (SELECT r, repo, owner, {groups} FROM docs)"


#: Texts of equal words are one node; probability Jaccard is at most the sum of the lesser shares, which tells the pairs it
#: is worked out for. With shingles ordered by the ratio of their counts, the larger of two quotients is one side's up to a
#: shingle and the other's beyond it.
NEAR_DUPLICATES = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), nodes AS (
    SELECT words, row_number() OVER () AS node FROM (SELECT DISTINCT words FROM docs)
), placed AS (
    SELECT node, len(words) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM nodes
), windows AS (
    SELECT node, size, k, concat_ws(' ', word, lead(word, 1) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w, lead(word, 4) OVER w) AS shingle
    FROM placed WINDOW w AS (PARTITION BY node ORDER BY k)
), shingles AS (
    SELECT node, shingle, count(*)::DOUBLE AS n FROM windows WHERE k = 1 OR k <= size - 4 GROUP BY node, shingle
), totals AS (
    SELECT node, sum(n) AS total FROM shingles GROUP BY node
), pairs AS (
    SELECT a.node AS a, b.node AS b
    FROM shingles AS a JOIN shingles AS b ON a.shingle = b.shingle AND a.node < b.node JOIN totals AS ta ON ta.node = a.node JOIN totals AS tb ON tb.node = b.node
    GROUP BY 1, 2 HAVING sum(least(a.n / ta.total, b.n / tb.total)) >= 0.8 - 1e-9
), sides AS (
    SELECT a, b, shingle, n AS p, 0 AS q FROM pairs JOIN shingles ON node = a
    UNION ALL
    SELECT a, b, shingle, 0, n FROM pairs JOIN shingles ON node = b
), merged AS (
    SELECT a, b, shingle, sum(p) AS p, sum(q) AS q, CASE WHEN sum(p) = 0 THEN 1e300 ELSE sum(q) / sum(p) END AS ratio FROM sides GROUP BY a, b, shingle
), summed AS (
    SELECT a, b, p, q, sum(p) OVER (PARTITION BY a, b ORDER BY ratio) AS before, sum(q) OVER (PARTITION BY a, b) - sum(q) OVER (PARTITION BY a, b ORDER BY ratio) AS after FROM merged
), alike AS (
    SELECT a, b FROM summed WHERE p > 0 AND q > 0 GROUP BY a, b HAVING sum(1 / (before / p + after / q)) >= 0.8 - 1e-9
), links AS (
    SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike
), reached(node, start) AS (
    SELECT node, node FROM nodes
    UNION
    SELECT links.b, start FROM reached JOIN links ON links.a = reached.node
), named AS (
    SELECT start AS node, min(doc_id) AS class_id FROM reached JOIN nodes USING (node) JOIN docs USING (words) GROUP BY start
)
SELECT doc_id, class_id FROM docs JOIN nodes USING (words) JOIN named USING (node)
"""


def secrets(repositories: int, owners: int) -> str:
    """repositories, owners: how many of each make a value an example."""
    return f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, chr(1)) AS repo, coalesce(source, chr(1)) AS owner FROM documents
), cut AS (
    {' UNION ALL '.join(_matches(place, pattern, least) for place, (_, pattern, least) in enumerate(KINDS))}
), placed AS (
    SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY r, place ORDER BY k) AS stop FROM cut
), long_enough AS (
    SELECT r, repo, owner, place, stop - length(whole) AS start, stop, value FROM placed WHERE length(value) >= least
), found AS (
    SELECT * FROM long_enough WHERE place < 3
    UNION ALL
    SELECT * FROM long_enough AS t
    WHERE place = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
        AND NOT EXISTS (SELECT 1 FROM long_enough AS b WHERE b.place < 3 AND b.r = t.r AND b.start < t.stop AND b.stop > t.start)
), spread AS (
    SELECT value, count(DISTINCT repo) >= {repositories} AND count(DISTINCT owner) >= {owners} AS example FROM found GROUP BY value
), judged AS (
    SELECT r, place, start, stop, example, [{', '.join(_quoted(k) for k, _, _ in KINDS)}][place + 1] || ':' || start || ':' || stop AS shown
    FROM found JOIN spread USING (value)
    WHERE place < 3 OR NOT example
), told AS (
    SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
        string_agg(shown, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(shown, ',' ORDER BY start, place) AS spans,
        count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example
    FROM judged GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN told USING (r)
"""


VARIANTS = f"""
WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
    SELECT run, n, {_crc32("doc || ':' || run")} AS h FROM runs
), words AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), gaps AS (
    SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM gaps AS a JOIN gaps AS b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
    UNION
    SELECT a.word, b.word, b.n FROM gaps AS a JOIN words AS b ON a.rest = b.word
    UNION
    SELECT b.word, a.word, a.n FROM gaps AS a JOIN words AS b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS most, first(other ORDER BY other_n DESC, other) AS other FROM near GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN other END AS form, CASE WHEN most >= 5 * n THEN most END AS form_n
    FROM words LEFT JOIN best USING (word)
), chain(word, root) AS (
    SELECT word, word FROM formed
    UNION ALL
    SELECT c.word, f.form FROM chain AS c JOIN formed AS f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed AS f JOIN chain AS c ON c.word = f.word JOIN formed AS last ON last.word = c.root
WHERE last.form IS NULL
"""

# states: 0 start, 1 system, 2 user, 3 assistant; the edits of a row are what is inserted in front of it, then its own
_WANTED = "[2, 2, 3, 2][{} + 1]"
_INSERTED = "['user:', 'user:', 'assistant:', 'user:'][{} + 1]"
_INSERTS = f"""
    SELECT c, i, cost, audit, state, lines FROM {{table}}
    UNION ALL
    SELECT c, i, cost + 2, audit || 'I', {_WANTED.format('state')}, list_append(lines, {_INSERTED.format('state')}) FROM {{table}}
    UNION ALL
    SELECT c, i, cost + 4, audit || 'II', {_WANTED.format(_WANTED.format('state'))}, list_append(list_append(lines, {_INSERTED.format('state')}), {_INSERTED.format(_WANTED.format('state'))}) FROM {{table}}
"""

CONVERSATIONS = f"""
WITH RECURSIVE convs AS (
    SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), hashed AS (
    SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(v.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
    FROM conversations AS v JOIN convs ON v.conv_id IS NOT DISTINCT FROM convs.conv_id
), damaged AS (
    SELECT c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS again
    FROM hashed WHERE fate <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), seen AS (
    SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS repeated FROM ordered
), faulty AS (
    SELECT c, i, turn, role, role || ':' || text AS line, substr(role, 1, 1) AS initial,
        CASE WHEN bare = '' THEN 'blank' WHEN repeated THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before
    FROM seen
), ways(c, i, cost, audit, state, lines) AS (
    SELECT c, 0::BIGINT, 0::BIGINT, '', 0, []::VARCHAR[] FROM convs
    UNION ALL
    SELECT * FROM (
        WITH ready AS ({_INSERTS.format(table='ways')}),
        met AS (SELECT ready.*, line, initial, fault, (fault = 'truncated')::BIGINT AS broken, fault NOT IN ('blank', 'duplicate') AS may_stay FROM ready JOIN faulty ON faulty.c = ready.c AND faulty.i = ready.i + 1)
        SELECT c, i + 1 AS i, cost + 3 AS cost, audit || 'D' AS audit, state, lines FROM met
        UNION ALL
        SELECT c, i + 1, cost + broken, audit || 'K', CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, list_append(lines, line) FROM met
        WHERE may_stay AND ((state = 0 AND initial IN ('s', 'u')) OR (state IN (1, 3) AND initial = 'u') OR (state = 2 AND initial = 'a'))
        UNION ALL
        SELECT c, i + 1, cost + 2 + broken, audit || 'R', {_WANTED.format('state')}, list_append(lines, {_INSERTED.format('state')} || substr(line, strpos(line, ':') + 1)) FROM met WHERE may_stay
    )
    QUALIFY row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) = 1
), counted AS (
    SELECT c, count(*) AS rows_left, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY c
), through AS (
    SELECT ways.* FROM ways LEFT JOIN counted USING (c) WHERE i = coalesce(rows_left, 0)
), ended AS (
    SELECT * FROM ({_INSERTS.format(table='through')}) WHERE state IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM convs JOIN ended USING (c) LEFT JOIN counted USING (c)
"""
