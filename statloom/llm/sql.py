"""SQL of the queries that SQL can express, as DuckDB runs it over the same tables."""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, u.b FROM r JOIN u ON r.y = u.a),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.c AS component_id, s.doc_id = c.c AS kept FROM s JOIN c ON s.doc_id = c.x
"""

OP10_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
k AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM p),
d AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM k JOIN d USING (k)),
l AS (SELECT r, list(j) AS j, count(*) AS n FROM c GROUP BY r)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN l.j IS NULL THEN w.w ELSE list_filter(w.w, lambda x, i: NOT list_contains(l.j, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN l ON w.r = l.r
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((sid - 1) % 3) + 1] AS w FROM o),
r AS (SELECT *, source_size * 2.0::DOUBLE AS full_size, source_size * 2.0::DOUBLE / w AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT first(level ORDER BY ratio, sid) AS level FROM l WHERE level <= ratio),
t AS (SELECT sid, source, source_size, CASE WHEN (SELECT level FROM c) IS NULL THEN full_size ELSE least(full_size, (SELECT level FROM c) * w) END AS target FROM r),
p AS (
  SELECT d.doc_id, d.size, t.sid, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS total,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT len(list_filter(range(62), lambda k: (1::BIGINT << k) < blocks)) AS bits
      FROM (SELECT ceil(coalesce(sum(floor(target + 0.5)), 0) / 1024)::BIGINT AS blocks FROM t)),
n AS (SELECT bits, 1::BIGINT << bits AS slots FROM b),
g AS (
  SELECT sid, floor(sum(target) OVER (ORDER BY sid) / sum(target) OVER () * slots + 0.5)::BIGINT AS hi, slots
  FROM t, n WHERE floor(target + 0.5) > 0),
i AS (SELECT sid, hi, lag(hi, 1, 0) OVER (ORDER BY sid) AS lo, slots FROM g),
v AS (
  SELECT slot, list_sum(list_transform(range(bits), lambda k: ((slot >> k) & 1) << (bits - 1 - k)))::BIGINT AS point
  FROM n, LATERAL (SELECT unnest(range(slots)) AS slot)),
q AS (
  SELECT sid, slot FROM i JOIN v ON coalesce(point, 0) >= lo AND coalesce(point, 0) < hi
  UNION ALL SELECT sid, sid + slots FROM i WHERE hi <= lo),
m AS (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank, count(*) OVER (PARTITION BY sid) AS slots FROM q),
f AS (
  SELECT p.*, CASE WHEN start < total % c * (total // c + 1) THEN start // (total // c + 1)
                   ELSE total % c + (start - total % c * (total // c + 1)) // greatest(total // c, 1) END AS rank
  FROM p LEFT JOIN (SELECT sid, any_value(slots) AS c FROM m GROUP BY 1) AS c USING (sid)),
taken AS (
  SELECT *, (greatest(0, least(start + size, total) - start) + greatest(0, least(source_size + start + size, total) - (source_size + start)))::BIGINT AS taken
  FROM f)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN m.slot END AS first_slot
FROM taken LEFT JOIN m ON m.sid = taken.sid AND m.rank = taken.rank
"""

#: crc32 of doc_id as text, bit by bit; null is read as empty text.
CRC32 = """CASE WHEN doc_id IS NULL THEN 0 ELSE xor(4294967295::UBIGINT, list_reduce(
 list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
 lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) END"""


def _discount(k: str, n: str) -> str:
    """The discount of a count k, from the numbers n1 to n4 of counts of 1 to 4."""
    forms = []
    for j in (1, 2, 3):
        a, b = f"{n}{j}", f"{n}{j + 1}"
        y = f"(CASE WHEN {n}1 > 0 THEN {n}1 / ({n}1 + 2 * {n}2) ELSE 0.5 END)"
        forms.append(f"WHEN {k} {'=' if j < 3 else '>='} {j} THEN CASE WHEN {a} > 0 THEN least(greatest({j} - {j + 1} * {y} * {b} / {a}, 0), {j}) ELSE 0.5 END")
    return f"(CASE {' '.join(forms)} ELSE 0 END)"


def _numbers(n: str, c: str) -> str:
    return ", ".join(f"count(*) FILTER ({c} = {k})::DOUBLE AS {n}{k}" for k in (1, 2, 3, 4))


#: Words end with ' ' as the end of a text and begin with '  ' as its start mark, which no word is.
OP4_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {CRC32} % 7 = 2 AS held_out,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
t AS (SELECT r, held_out, unnest(list_prepend('  ', w)) AS u, unnest(list_append(w, ' ')) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
p AS (SELECT u, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, w),
n AS (SELECT w, count(*) AS n FROM p GROUP BY w),
x AS (SELECT u, sum(c)::DOUBLE AS t, count(*) FILTER (c = 1) AS x1, count(*) FILTER (c = 2) AS x2, count(*) FILTER (c > 2) AS x3 FROM p GROUP BY u),
s AS (SELECT (SELECT coalesce(sum(c), 0) FROM c)::BIGINT AS tokens, (SELECT count(*) FROM c)::BIGINT AS v, (SELECT count(*) FROM p)::DOUBLE AS pairs, a.*, b.*
      FROM (SELECT {_numbers("p", "c")} FROM p) a, (SELECT {_numbers("q", "n")} FROM n) b),
g AS (SELECT *, CASE WHEN pairs > 0 THEN ({_discount("1", "q")} * q1 + {_discount("2", "q")} * q2 + {_discount("3", "q")} * (v - q1 - q2)) / pairs ELSE 1 END AS spare FROM s),
l AS (
  SELECT t.r, coalesce(c.c, 0) AS c, x.t AS total, coalesce(p.c, 0) AS pc, g.*, x1, x2, x3,
         CASE WHEN pairs > 0 THEN (coalesce(n.n, 0) - {_discount("coalesce(n.n, 0)", "q")}) / pairs ELSE 0 END + spare / (v + 1) AS lower
  FROM t CROSS JOIN g LEFT JOIN c ON t.w = c.w LEFT JOIN n ON t.w = n.w LEFT JOIN x ON t.u = x.u LEFT JOIN p ON t.u = p.u AND t.w = p.w),
e AS (
  SELECT r, count(*)::BIGINT AS n_tokens, count(*) FILTER (c > 0)::BIGINT AS n_known, any_value(tokens) AS train_tokens,
         sum(log10((c + 1) / (tokens + v + 1)::DOUBLE)) AS base_score,
         sum(log10(CASE WHEN total > 0 THEN (pc - {_discount("pc", "p")}) / total
           + (x1 * {_discount("1", "p")} + x2 * {_discount("2", "p")} + x3 * {_discount("3", "p")}) / total * lower ELSE lower END)) AS score
  FROM l GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN e USING (r)
"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")


def _matches(name: str, kind: int, pattern: str, keep: str) -> str:
    """The matches of a pattern, with the gap before each. keep: a condition on a match m."""
    lists = f"SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d"
    rows = f"SELECT r, unnest(m) AS m, unnest(g[1:len(m)]) AS g, unnest(range(len(m))) AS i FROM ({lists})"
    return f"SELECT r, '{name}' AS name, {kind} AS kind, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i)::BIGINT AS stop, {keep} AS keep FROM ({rows})"


L3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_matches("assign", 0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 1)) >= 8")}
  UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16")} UNION ALL {_matches("hex", 2, "[0-9a-f]+", "length(m) >= 32")}),
s AS (
  SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
         string_agg(name || ':' || (stop - length(m)) || ':' || stop, ',' ORDER BY stop - length(m), kind) AS spans
  FROM f WHERE keep GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN s USING (r)
"""

def _u32(*numbers: str) -> str:
    return " || ".join(f"printf('%08x', ({x})::BIGINT)" for x in numbers)


def _box(kind: str, *parts: str) -> str:
    """Hexadecimal digits of a box: its size, kind and body. Parts are SQL of digits; literals or columns, as each is named twice."""
    body = " || ".join(parts)
    return f"(printf('%08x', (8 + length({body}) // 2)::BIGINT) || '{kind.encode().hex()}' || {body})"


_MATRIX = "'000100000000000000000000000000000001000000000000000000000000000040000000'"
_ENTRY = "'00000024726177200000000000000001000000000000000000010008000000001f400000'"  # 8-bit samples, 8,000 a second
_PLAIN = "'00000000'"  # version and flags of a full box
#: Containers of one track, byte for byte: n samples of 192 bytes in chunks of 8, every 16th a key. f is the file's first sample byte.
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
p AS (SELECT *, greatest(1, (n_bytes + 191) // 192) AS n FROM d),
q AS (SELECT *, n * 192 AS size, (n + 7) // 8 AS chunks, (n + 15) // 16 AS keys, lower(hex(encode(t || repeat(' ', n * 192 - n_bytes)))) AS h FROM p),
a AS (SELECT *, n - (chunks - 1) * 8 AS rest, lower(printf('%016x', size)) AS wide,
  {_box("stsd", _PLAIN, "'00000001'", _ENTRY)} AS stsd,
  {_PLAIN} || {_u32("1", "n", "192")} AS stts, {_PLAIN} || {_u32("keys")} || array_to_string(list_transform(range(keys), lambda k: printf('%08x', k * 16 + 1)), '') AS stss,
  {_PLAIN} || {_u32("192", "n")} AS stsz FROM q),
b AS (SELECT *, CASE WHEN chunks = 1 THEN {_u32("1", "1", "rest", "1")} WHEN rest = 8 THEN {_u32("1", "1", "8", "1")}
  ELSE {_u32("2", "1", "8", "1", "chunks", "rest", "1")} END AS runs FROM a),
c AS (SELECT *, {_PLAIN} || runs AS stsc,
  20 + 8 + 8 + 120 + 8 + 104 + 8 + 44 + 33 + 8 + 16 + 36 + 8 + length(stsd) // 2 + 8 + length(stts) // 2 + 8 + length(stss) // 2 + 12 + length(runs) // 2
  + 8 + length(stsz) // 2 + 16 + 4 * chunks AS f FROM b),
e AS (SELECT *, {_PLAIN} || {_u32("chunks")} || array_to_string(list_transform(range(chunks), lambda k: printf('%08x', f + k * 1536)), '') AS stco FROM c),
g AS (SELECT *, stsd || {_box("stts", "stts")} || {_box("stss", "stss")} || {_box("stsc", "stsc")} || {_box("stsz", "stsz")} || {_box("stco", "stco")} AS stbl FROM e),
i AS (SELECT *, {_box("smhd", "'0000000000000000'")} || {_box("dinf", "'0000001c6472656600000000000000010000000c75726c2000000001'")} || {_box("stbl", "stbl")} AS minf FROM g),
j AS (SELECT *, '01000000' || repeat('00', 16) || {_u32("8000")} || wide || '55c40000' AS mdhd, '00000000' || '00000000' || '736f756e' || repeat('00', 13) AS hdlr FROM i),
k AS (SELECT *, {_box("mdhd", "mdhd")} || {_box("hdlr", "hdlr")} || {_box("minf", "minf")} AS mdia,
  '01000007' || repeat('00', 16) || '0000000100000000' || wide || repeat('00', 8) || '0000000001000000' || {_MATRIX} || repeat('00', 8) AS tkhd FROM j),
l AS (SELECT *, {_box("tkhd", "tkhd")} || {_box("mdia", "mdia")} AS trak,
  '01000000' || repeat('00', 16) || {_u32("8000")} || wide || '00010000' || '0100' || repeat('00', 10) || {_MATRIX} || repeat('00', 24) || '00000002' AS mvhd FROM k),
m AS (SELECT *, {_box("mvhd", "mvhd")} || {_box("trak", "trak")} AS moov FROM l),
o AS (SELECT *, '0000001466747970717420200000000071742020' || {_box("moov", "moov")} || {_u32("8 + size")} || '6d646174' || h AS media FROM m),
x AS (SELECT *, right(h, 32) AS tail FROM o)
SELECT doc_id, n_bytes, size::BIGINT AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(16), lambda z: (16 * instr('0123456789abcdef', tail[2 * z + 1]) + instr('0123456789abcdef', tail[2 * z + 2]) - 17)::UBIGINT)),
    lambda u, v: list_reduce(list_prepend(xor(u, v), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, w: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))))::BIGINT AS tail_crc32,
  (length(media) // 2)::BIGINT AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'codec=raw ;kind=soun;timescale=8000;duration=' || size || ';samples=' || n || ';keyframes='
    || array_to_string(list_transform(range(keys), lambda z: (f + z * 3072) || '+192'), ',') AS feature FROM x
"""

OP11_SQL = r"""
WITH RECURSIVE x AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM x WHERE label IS NOT NULL AND len(list_filter(e, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS (SELECT a.r AS a, b.r AS b FROM n a JOIN n b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0
      WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93::DOUBLE),
r AS (SELECT r AS x, r AS y FROM x UNION SELECT r.x, p.b FROM r JOIN p ON r.y = p.a),
c AS (SELECT r.x, min(x.vec_id) AS c FROM r JOIN x ON r.y = x.r GROUP BY 1),
l AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, c AS component_id, vec_id IS NOT DISTINCT FROM c AS kept FROM x JOIN c ON x.r = c.x LEFT JOIN l ON x.r = l.a
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
e AS (SELECT r, unnest(w) AS w FROM d),
c AS (SELECT r, w, count(*) AS n FROM e GROUP BY 1, 2),
v AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, n AS s, 0 AS t FROM c UNION ALL SELECT w, 0, 1 FROM b) GROUP BY 1),
k AS (SELECT *, (xor(4294967295::UBIGINT, list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(w), 2 * i - 1, 2))::UBIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
          lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) % 10000)::BIGINT AS k FROM v),
g AS (SELECT k, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM k GROUP BY 1),
f AS (SELECT k, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM g) + 10000) / ((s + 1) * ((SELECT sum(t) FROM g) + 10000))))::BIGINT AS gain FROM g),
x AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM c JOIN k USING (w) JOIN f USING (k) GROUP BY 1),
s AS (SELECT r, doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS noise
      FROM d LEFT JOIN x USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM s LEFT JOIN o USING (r)
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT r, lang, source, unnest(w) AS w FROM d),
k AS (SELECT lang, w, count(*) AS total FROM e GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, w, count(*) AS c FROM e JOIN k USING (lang, w) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, v.v, v.n AS all_n, coalesce((SELECT sum(c) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM g JOIN v ON g.lang = v.lang),
p AS (SELECT n.lang, n.source, k.w, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 5)::HUGEINT) // (n.n + 5 * v) AS p,
        1 + (1000000000 * (k.total + 5)::HUGEINT) // (all_n + 5 * v) AS q
      FROM n JOIN k ON n.lang = k.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.w = k.w),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.w = y.w
        WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, w AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= 50
"""
