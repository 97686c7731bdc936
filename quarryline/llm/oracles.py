"""SQL (for DuckDB) of the queries of this package that SQL can express."""

from __future__ import annotations

import re
import string

from .license_rules import RULES
from .licenses import BASE, SCORE
from .simhash import BITS, SEED, SHINGLE

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Bytes are pairs of hexadecimal digits here; every position of every text is a row. Texts are first cut into parts that overlap, as taking pieces of long strings is slow.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(0, len(h), 1000)) AS o FROM d),
x AS (SELECT doc_id, n, o // 2 AS base, substr(h, o + 1, 1100) AS part FROM e),
p AS (SELECT doc_id, n, base, part, unnest(range(0, least(500, n - base))) AS j FROM x),
g AS (SELECT doc_id, base + j AS k, substr(part, 2 * j + 1, 2) AS b, CASE WHEN base + j + 50 <= n THEN substr(part, 2 * j + 1, 100) END AS s FROM p),
f AS (SELECT s, min(doc_id) AS least FROM g WHERE s IS NOT NULL GROUP BY s),
c AS (SELECT g.doc_id, k, b, sum(CASE WHEN f.least < g.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id ORDER BY k) AS hits FROM g LEFT JOIN f ON g.s = f.s),
m AS (SELECT doc_id, k, b, CASE WHEN hits > lag(hits, 50, 0) OVER (PARTITION BY doc_id ORDER BY k) THEN 1 ELSE 0 END AS gone FROM c),
r AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM m),
a AS (SELECT doc_id, sum(gone) AS n_removed, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS n_spans, string_agg(b, '' ORDER BY k) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

CONTAMINATION = f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
ik AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0),
ip AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM ik),
ns AS (SELECT DISTINCT n FROM ip),
dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM t, ns WHERE len(w) >= n),
h AS (SELECT doc_id, k, dk.n, item FROM dk JOIN ip ON dk.n = ip.n AND array_to_string(w[k:k + dk.n - 1], ' ') = ip.s),
q AS (SELECT doc_id, k + unnest(range(0, n)) AS pos FROM h),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM q GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN c ON t.doc_id = c.doc_id LEFT JOIN x ON t.doc_id = x.doc_id
"""

#: Five hexadecimal digits of SHA-1 are four digits of base 32.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages),
s AS (SELECT *, sha1(html) AS x FROM p),
n AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM s)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[i // 4 + 1] // CAST(32 ** (3 - i % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM n
"""


def _license_sql() -> str:
    r"""Detections by definition: one goes if any other of higher rank covers it.

    DuckDB's expressions look neither back nor ahead. So letters beyond ASCII
    are told as ``A``, which gives words the beginnings that ``\b`` finds, and
    every word ends in a bar, which a match takes.
    """

    def barred(pattern: str) -> str:
        first = {"[^ ]* ?": r"(?:[^| ]+(?:\| )?)?", ".{": r"(?:[^| ]|\| ){", " ?": r"(?:\| )?", " ": r"\| "}
        return re.sub(r"\[\^ \]\* \?|\.\{| \?| ", lambda m: first[m[0]], pattern)

    rules = ", ".join(f"({r.number}, {r.priority}, '{r.label}', '{r.keyword}', '{barred(r.pattern)}')" for r in RULES)
    phrases = [(label, " AND ".join(f"w[k + {j}] = '{word}'" for j, word in enumerate(phrase.split(), 1))) for phrase, label in BASE]
    places = ", ".join(f"list_filter(range(len(w)), lambda k: {same}) AS at_{label}" for label, same in phrases)
    every = "list_concat(" + ", ".join(f"at_{label}" for label, _ in phrases) + ")"
    labels = "list_filter([" + ", ".join(f"CASE WHEN len(at_{label}) > 0 THEN '{label}' END" for label, _ in phrases) + "], lambda x: x IS NOT NULL)"
    worth = " ".join(f"WHEN {p} THEN {s}" for p, s in SCORE.items())
    return rf"""
WITH rules(number, priority, label, keyword, pattern) AS (VALUES {rules}),
n AS (SELECT doc_id, regexp_replace(regexp_replace(' ' || {_LOW} || ' ', '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^\x00-\x7F]', 'A', 'g') AS norm FROM documents),
m AS (SELECT doc_id, number, priority, label, string_split(regexp_replace(replace(norm, ' ', '| '), '\b(' || pattern || ')\|', chr(1) || '\1' || chr(2), 'g'), ' ') AS w FROM n JOIN rules ON contains(norm, keyword)),
x AS (SELECT doc_id, number, priority, label, unnest(list_filter(range(len(w)), lambda i: starts_with(w[i + 1], chr(1)))) - 1 AS b, unnest(list_filter(range(len(w)), lambda i: ends_with(w[i + 1], chr(2)))) AS e FROM m),
f AS (SELECT * FROM x d WHERE NOT EXISTS (SELECT 1 FROM x o WHERE o.doc_id = d.doc_id AND o.b <= d.b AND o.e >= d.e AND (o.priority > d.priority OR o.priority = d.priority AND (o.e - o.b > d.e - d.b OR o.e - o.b = d.e - d.b AND o.number < d.number)))),
g AS (SELECT doc_id, list(DISTINCT label) AS labels, max(priority) AS best, count(*) AS n FROM f GROUP BY doc_id),
t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {places} FROM t),
q AS (SELECT doc_id, n_words, {every} AS places, {labels} AS base FROM p)
SELECT q.doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
CAST(greatest(CASE best {worth} ELSE 0 END, CASE WHEN len(places) > 0 THEN {SCORE[2]} ELSE 0 END) AS DOUBLE) AS score, coalesce(n, 0) AS n_detections
FROM q LEFT JOIN g ON q.doc_id = g.doc_id
"""


LICENSES = _license_sql()


def _simhash_sql() -> str:
    """XXH64 in 128-bit numbers, the fingerprints, and every pair of different fingerprints.

    A rotation is a product modulo ``2**64 - 1`` (a word of ones alone would become zero: one value of ``2**64``).
    """
    # fixed values of XXH64
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    whole, ones = f"{1 << 64}::UHUGEINT", f"{(1 << 64) - 1}::UHUGEINT"

    def times(a: str, p: str, plus: str = "0::UHUGEINT") -> str:
        return f"((({a}) * {p} + {plus}) % {whole})"

    def turn(a: str, by: int) -> str:
        return f"(({a}) * {1 << by}::UHUGEINT % {ones})"

    def word(at: str, size: int = 8) -> str:
        return "CAST('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * j + 1}, 2)" for j in reversed(range(size))) + " AS UBIGINT)::UHUGEINT"

    def lane(a: str) -> str:
        return times(turn(times(a, p2), 31), p1)

    starts = [f"({SEED}::UHUGEINT + {p1} + {p2}) % {whole}", f"({SEED}::UHUGEINT + {p2}) % {whole}", f"{SEED}::UHUGEINT", f"({SEED}::UHUGEINT + {whole} - {p1}) % {whole}"]
    lanes = [f"list_reduce(list_transform(range(n // 32), lambda j: {times(word(f'32 * j + {8 * i}'), p2)}), lambda v, k: {times(turn(f'(v + k) % {whole}', 31), p1)}, {start}) AS v{i}" for i, start in enumerate(starts)]
    merged = "(" + " + ".join(turn(f"v{i}", by) for i, by in enumerate((1, 7, 12, 18))) + f") % {whole}"
    for i in range(4):
        merged = times(f"xor({merged}, {lane(f'v{i}')})", p1, p4)
    eights = f"list_reduce(list_transform(range(n % 32 // 8), lambda j: {word('n - n % 32 + 8 * j')}), lambda a, k: {times(turn(f'xor(a, {lane("k")})', 27), p1, p4)}, h)"
    four = times(turn(f"xor(h, {times(word('n - n % 8', 4), p1)})", 23), p2, p3)
    single = f"list_reduce(list_transform(range(n - n % 4, n), lambda o: {word('o', 1)}), lambda a, b: {times(turn(f'xor(a, {times("b", p5)})', 11), p1)}, h)"
    bits = " + ".join(f"CASE WHEN 2 * sum(c * ((h >> {b}) & 1)) > sum(c) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE}, 0) + 2)) AS k FROM t WHERE len(w) > 0),
g AS MATERIALIZED (SELECT doc_id, s, count(*) AS c FROM (SELECT doc_id, array_to_string(w[k:k + {SHINGLE - 1}], ' ') AS s FROM k) GROUP BY doc_id, s),
u AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM (SELECT DISTINCT s FROM g)),
h0 AS (SELECT s, x, n, {', '.join(lanes)} FROM u),
h1 AS (SELECT s, x, n, (CASE WHEN n >= 32 THEN {merged} ELSE {SEED}::UHUGEINT + {p5} END + n::UHUGEINT) % {whole} AS h FROM h0),
h2 AS (SELECT s, x, n, {eights} AS h FROM h1),
h3 AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM h2),
h4 AS (SELECT s, {single} AS h FROM h3),
h5 AS (SELECT s, {times(f'xor(h, h // {1 << 33}::UHUGEINT)', p2)} AS h FROM h4),
h6 AS (SELECT s, {times(f'xor(h, h // {1 << 29}::UHUGEINT)', p3)} AS h FROM h5),
h7 AS (SELECT s, CAST(xor(h, h // {1 << 32}::UHUGEINT) AS UBIGINT) AS h FROM h6),
f AS (SELECT doc_id, CAST({bits} AS UBIGINT) AS fp FROM g JOIN h7 ON g.s = h7.s GROUP BY doc_id),
d AS MATERIALIZED (SELECT t.doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM t LEFT JOIN f ON t.doc_id = f.doc_id),
v AS (SELECT DISTINCT fp FROM d),
e AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM v a JOIN v b ON bit_count(CAST(xor(a.fp, b.fp) AS BIT)) <= {BITS} AND a.fp <> b.fp),
r(fp, id) USING KEY (fp) AS (SELECT fp, min(doc_id) FROM d GROUP BY fp UNION SELECT e.b, min(r.id) FROM r JOIN e ON e.a = r.fp JOIN recurring.r o ON o.fp = e.b WHERE r.id < o.id GROUP BY e.b)
SELECT doc_id, lpad(lower(hex(d.fp)), 16, '0') AS fingerprint, id AS component_id FROM d JOIN r ON d.fp = r.fp
"""


SIMHASH = _simhash_sql()
