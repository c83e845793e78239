"""The same results in plain SQL, for the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = n.doc_id"""

LINE_DEDUP = r"""WITH l AS (SELECT doc_id, no, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) a) b),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS pos FROM l WHERE body <> ''),
w AS (SELECT a.doc_id, a.pos, a.no AS n1, b.no AS n2, c.no AS n3, a.body AS b1, b.body AS b2, c.body AS b3 FROM k a JOIN k b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN k c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2),
f AS (SELECT *, row_number() OVER (PARTITION BY b1, b2, b3 ORDER BY doc_id, pos) AS occurrence FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([n1, n2, n3]) AS no FROM f WHERE occurrence > 1),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(g.no) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE g.no IS NULL) AS kept FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed, CASE WHEN coalesce(t.n_removed, 0) = 0 THEN d.text ELSE coalesce(t.kept, '') END AS text FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id"""

# every item-sized window between the first and the last shingle that a text shares with an item; 0.4 of the item's shingles at least must be met at all
DECONTAMINATION = rf"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents),
ig AS (SELECT item_id, len(w) AS m, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g, unnest(range(1, len(w) - 3)) AS j FROM i WHERE len(w) >= 5),
dg AS (SELECT doc_id, len(w) AS size, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5),
hit AS (SELECT DISTINCT doc_id, item_id, m, size, k FROM dg JOIN (SELECT DISTINCT item_id, m, g FROM ig) x USING (g)),
reach AS (SELECT doc_id, item_id, m, size, min(k) - 1 AS low, max(k) - 1 AS high FROM hit GROUP BY ALL HAVING count(*) >= 0.4 * (m - 4)),
st AS (SELECT doc_id, item_id, m, unnest(CASE WHEN size <= m THEN [0] ELSE range(greatest(0, low - m + 5), least(high, size - m) + 1) END) AS start FROM reach),
lined AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(k - j, size - m)) AS start FROM dg JOIN ig USING (g)),
wg AS (SELECT s.doc_id, s.item_id, s.m, s.start, g, count(*) AS c FROM st s JOIN dg ON dg.doc_id = s.doc_id AND dg.k - 1 >= s.start AND dg.k + 4 <= s.start + s.m GROUP BY ALL),
wn AS (SELECT doc_id, item_id, start, sum(c) AS n FROM wg GROUP BY ALL), ic AS (SELECT item_id, g, count(*) AS c FROM ig GROUP BY ALL), n AS (SELECT item_id, sum(c) AS n FROM ic GROUP BY ALL),
x AS (SELECT wg.doc_id, wg.item_id, wg.m, wg.start, sum(least(wg.c, ic.c)) AS x FROM wg JOIN ic ON ic.item_id = wg.item_id AND ic.g = wg.g GROUP BY ALL),
sc AS (SELECT x.*, x.x / (wn.n + n.n - x.x) AS sim FROM x JOIN wn ON wn.doc_id = x.doc_id AND wn.item_id = x.item_id AND wn.start = x.start JOIN n ON n.item_id = x.item_id)
SELECT doc_id, item_id, start, m AS n_words, round(sim, 6) AS similarity FROM (SELECT sc.*, row_number() OVER (PARTITION BY sc.doc_id, sc.item_id ORDER BY sim DESC, l.start IS NULL, sc.start) AS k FROM sc LEFT JOIN lined l ON l.doc_id = sc.doc_id AND l.item_id = sc.item_id AND l.start = sc.start WHERE sim >= 0.75) y WHERE k = 1"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL_SEARCH = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS t FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS nn, CAST(sum(len(t)) AS BIGINT) AS ll FROM d),
x AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, len(t) AS n, unnest(t) AS term FROM d) u GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM x GROUP BY term),
i AS (SELECT item_no, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS item_no, item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark) b) u GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM f, s),
sc AS (SELECT item_no, item_id, row_no, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll)))) AS BIGINT) AS score FROM i JOIN x USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) y WHERE rank <= 20"""

ORACLES = {"op2_line_dedup": LINE_DEDUP, "op3_ngram_join": NGRAM_JOIN, "op9_decontamination": DECONTAMINATION, "op12_lexical_search": LEXICAL_SEARCH}
