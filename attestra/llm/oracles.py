"""SQL that computes, in another way, what those queries of this subpackage return that SQL can express."""

from __future__ import annotations

from . import chat_snapshots, kd_clusters, mixing, range_spelling, secrets, sharding, url_rules

WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

#: Rows ``r`` and their links ``e(a, b)`` in both directions to the rows that each one reaches.
REACH = """reach AS (SELECT r, r AS q FROM rows UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.q)"""

VECTORS = f"""WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS MATERIALIZED (SELECT r, label, v, sqrt(list_dot_product(v, v)) AS size FROM rows WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: (x IS NULL OR NOT isfinite(x)))) = 0 AND len(list_filter(v, lambda x: (x <> 0))) > 0),
e AS MATERIALIZED (SELECT x.r AS a, y.r AS b FROM fine x JOIN fine y ON x.label = y.label AND len(x.v) = len(y.v) AND x.r <> y.r WHERE list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.93),
{REACH},
n AS (SELECT a AS r, count(*) AS n FROM e GROUP BY a), c AS (SELECT reach.r, min(vec_id) AS component_id FROM reach JOIN rows ON rows.r = reach.q GROUP BY reach.r)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM rows JOIN c USING (r) LEFT JOIN n USING (r)"""

NEAR_COPIES = f"""WITH RECURSIVE rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT r, unnest(CASE WHEN len(w) < 5 THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END) AS g FROM rows),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
{REACH}, c AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN rows ON rows.r = reach.q GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM rows JOIN c USING (r) LEFT JOIN n USING (r)"""


def _crc32() -> str:
    """CRC-32 of a column ``text``, byte by byte from its hexadecimal form, half a byte at a time."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    digit = lambda at: f"(instr('0123456789ABCDEF', x[{at}]) - 1)"
    half = lambda c: f"xor(({c}) >> 4, {table}[(({c}) & 15) + 1])"
    byte = f"list_transform(range(1, len(x), 2), lambda i: CAST({digit('i')} * 16 + {digit('i + 1')} AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


SHARDS = f"""WITH h AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS x FROM documents),
d AS MATERIALIZED (SELECT doc_id, source, size, CAST({_crc32()} AS BIGINT) AS text_crc32 FROM h),
k AS (SELECT *, md5(concat_ws(':', '{sharding.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(text_crc32 AS VARCHAR))) AS draw FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + CAST(0.5 AS DOUBLE)) / n, draw, doc_id, text_crc32, source NULLS LAST) - 1 AS position, count(*) OVER () AS total FROM r),
q AS (SELECT *, position * {sharding.SHARDS} // total AS k FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(k AS INT) AS shard, position - (k * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard FROM q"""


def _secrets() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = [f"SELECT r, {k} AS kind, string_split_regex(text, {quoted(p)}) AS g, regexp_extract_all(text, {quoted(p)}) AS m, regexp_extract_all(text, {quoted(p)}, {group}) AS v, {least} AS least FROM t" for k, (_, p, least, group) in enumerate(secrets.KINDS)]
    names = [k[0] for k in secrets.KINDS]
    written = "string_agg(concat_ws(':', " + f"{names}[kind + 1], start, stop), ',' ORDER BY start, kind, stop)"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{names[k]}" for k in range(secrets.BASE))
    return f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(found)}), i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m WHERE len(m) > 0),
s AS MATERIALIZED (SELECT r, kind, list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS n, v[i] AS value,
  regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Za-z]') AND len(list_distinct(string_split(v[i], ''))) >= 10 AND NOT regexp_matches(v[i], {quoted(secrets.STAND_IN)}) AS live FROM i WHERE length(v[i]) >= least),
a AS MATERIALIZED (SELECT r, kind, start, start + n AS stop, value, live FROM s WHERE kind < {secrets.BASE} OR live AND NOT EXISTS (SELECT 1 FROM s b WHERE b.r = s.r AND b.kind < {secrets.BASE} AND b.start < s.start + s.n AND b.start + b.n > s.start)),
o AS (SELECT value, count(DISTINCT struct_pack(s := source)) AS owners, count(DISTINCT struct_pack(s := source, d := doc_id)) AS repositories FROM a JOIN t USING (r) GROUP BY value),
j AS MATERIALIZED (SELECT *, owners >= {secrets.COPIED_OWNERS} OR repositories >= {secrets.COPIED_REPOSITORIES} AS copied FROM a JOIN o USING (value)),
k AS (SELECT *, live AND owners = 1 AND NOT copied AS now FROM j), kept AS (SELECT * FROM k WHERE kind < {secrets.BASE} OR now),
b AS (SELECT r, {counts}, {written} AS base FROM a WHERE kind < {secrets.BASE} GROUP BY r),
w AS (SELECT r, {written} AS spans, count(*) FILTER (copied) AS n_copied, count(*) FILTER (now) AS n_live, max(repositories) AS most_repositories FROM kept GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in names[: secrets.BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live, coalesce(most_repositories, 0) AS most_repositories
FROM t LEFT JOIN b USING (r) LEFT JOIN w USING (r)"""


CHATS = f"""WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS ts FROM d GROUP BY conv_id),
w AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ts), p AS (SELECT DISTINCT ts[1 : k] AS ts FROM (SELECT ts, unnest(range(1, len(ts))) AS k FROM c))
SELECT conv_id, len(ts) AS n_turns, n_copies, array_to_string(list_transform(ts, lambda t: '{chat_snapshots.BEGIN}' || replace(coalesce(t.role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || '{chat_snapshots.END}'), chr(10)) AS chat
FROM w ANTI JOIN p USING (ts)"""

WRITTEN_URLS = f"""WITH u AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT page_id, coalesce(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(path, '') AS path FROM u),
w(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_rules.RULES)}),
f AS (SELECT page_id, arg_max(struct_pack(r := h || p, v := verdict), length(h || p)) AS best FROM l JOIN w ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, best.r AS rule, best.v AS ruled FROM l LEFT JOIN f USING (page_id)"""

TARGETS = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS i, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
it AS (SELECT 0 AS step, list(size ORDER BY i) AS s, list({list(mixing.WEIGHTS)}[CAST((i - 1) % {len(mixing.WEIGHTS)} + 1 AS INT)] ORDER BY i) AS w, list(false ORDER BY i) AS done FROM s
  UNION ALL SELECT step + 1, s, w, list_transform(range(1, len(s) + 1), lambda i: (done[i] OR rest * w[i] / open > {mixing.MOST} * s[i])) FROM
  (SELECT *, CAST(list_sum(s) - {mixing.MOST} * coalesce(list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN done[i] THEN s[i] ELSE 0 END)), 0) AS DOUBLE) AS rest, list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN done[i] THEN 0 ELSE w[i] END)) AS open FROM it WHERE step < len(s))),
z AS (SELECT *, CAST(list_sum(s) - {mixing.MOST} * coalesce(list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN done[i] THEN s[i] ELSE 0 END)), 0) AS DOUBLE) AS rest, list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN done[i] THEN 0 ELSE w[i] END)) AS open FROM it ORDER BY step DESC LIMIT 1)
SELECT doc_id, d.size, s.size AS source_size, CASE WHEN z.done[i] THEN CAST({mixing.MOST} * s.size AS DOUBLE) ELSE z.rest * z.w[i] / z.open END AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, z"""



def _clusters() -> str:
    c = kd_clusters
    assigned = lambda i: f"a{i} AS MATERIALIZED (SELECT r, best.c AS c, best.d AS d FROM (SELECT r, min(struct_pack(d := CAST(pp - 2 * list_dot_product(p, z) + list_dot_product(z, z) AS BIGINT), c := c)) AS best FROM k, c{i} GROUP BY r))"
    moved = lambda i: f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.z, c{i}.z) AS z FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS z FROM (SELECT c, j, CAST(sum(p[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN k USING (r), range(1, {c.COMPONENTS + 1}) t(j) GROUP BY c, j) GROUP BY c) m USING (c))"
    steps = ",\n".join(f"{assigned(i)}, {moved(i)}" for i in range(c.ROUNDS))
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, p, list_dot_product(p, p) AS pp FROM (SELECT vec_id, list_transform(embedding, lambda x: floor({c.SCALE} * CAST(x AS DOUBLE))) AS p FROM embeddings WHERE len(embedding) = {c.COMPONENTS} AND len(list_filter(embedding, lambda x: (x IS NULL OR NOT isfinite(x)))) = 0)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{c.SALT}:' || vec_id), p) - 1 AS c, p AS z FROM k QUALIFY c < {c.CENTROIDS}),
{steps}, {assigned(c.ROUNDS)}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(z, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a{c.ROUNDS} JOIN k USING (r) JOIN c{c.ROUNDS} USING (c)"""


def _variants() -> str:
    v = range_spelling
    return f"""WITH RECURSIVE r AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{v.LETTERS}]{{{v.LEAST_LENGTH},}}')) AS w FROM documents) GROUP BY ALL),
x AS (SELECT w, k, string_split(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), '') AS x FROM r), h AS (SELECT w, k, {_crc32()} AS h FROM x),
d AS (SELECT CASE WHEN h % {v.DAMAGED} = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, k FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= {v.LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {v.LEAST_COUNT}),
l AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM l a JOIN l b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION SELECT l.word, w.word FROM l JOIN w ON l.less = w.word UNION SELECT w.word, l.word FROM l JOIN w ON l.less = w.word),
m AS MATERIALIZED (SELECT a AS word, count(*) AS n_near, min(struct_pack(k := -w.n, b := b)) AS best FROM p JOIN w ON w.word = b GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.k >= {v.MORE_FREQUENT} * n THEN best.b END AS form, CASE WHEN -best.k >= {v.MORE_FREQUENT} * n THEN -best.k END AS form_n FROM w LEFT JOIN m USING (word)),
g AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL),
e AS (SELECT g.word, g.root FROM g JOIN f ON f.word = g.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)"""


ORACLE_SQL = {
    "op1_pivot_index": VECTORS,
    "op4_secret_owners": _secrets(),
    "op6_interleaved_shards": SHARDS,
    "op7_ngram_join": NEAR_COPIES,
    "op9_chat_snapshots": CHATS,
    "op11_kd_clusters": _clusters(),
    "op13_range_spelling": _variants(),
    "written_url_rules": WRITTEN_URLS,
    "mixture_targets": TARGETS,
}
