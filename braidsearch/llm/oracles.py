"""DuckDB SQL that each registered query of this subpackage must equal, where SQL can say it."""

from __future__ import annotations

from hashlib import md5

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL
), sized AS (
  SELECT item, w, least(13, len(w)) AS n FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM sized, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), docs AS (
  SELECT doc_id, {WORDS} AS w, row_number() OVER () AS r FROM documents
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM docs, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), found AS (
  SELECT r, i, p.n, item FROM places p JOIN windows USING (n, phrase)
), hit AS (
  SELECT r, count(DISTINCT j) AS n_hit
  FROM (SELECT DISTINCT r, i, n FROM found), LATERAL (SELECT unnest(range(i, i + n)) AS j) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
  FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

# Kind, pattern, group and its least length, as the query lists them.
KINDS = [
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{3,100}@", 0, 1),
]


def _kind(n: int, name: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    whole = f"regexp_extract_all(t, '{quoted}', 0)"
    return f"""
  SELECT r, {n} AS n, '{name}' AS kind, start, start + size AS stop FROM (
    SELECT r, len(ms[i]) AS size, len(vs[i]) AS value,
      list_sum(list_transform(gaps[1:i], lambda x: len(x)))
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS start
    FROM (SELECT r, {whole} AS ms, regexp_extract_all(t, '{quoted}', {group}) AS vs,
            string_split_regex(t, '{quoted}') AS gaps
          FROM docs WHERE regexp_matches(t, '{quoted}')),
      LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i)
  ) WHERE value >= {least}"""


OP8 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
found AS ({" UNION ALL ".join(_kind(n, *kind) for n, kind in enumerate(KINDS))}),
joined AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, n, stop)
      FILTER (n < 3) AS base,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, n, stop) AS spans
  FROM found GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (r)
"""

OP10 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole a, whole b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# The number of words, the first 60 bits of an id's MD5.
COUNT = f"len({WORDS})"
HASH = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"

OP1 = f"""
WITH RECURSIVE lengths AS (
  SELECT doc_id, {HASH} AS h, CAST({COUNT} AS BIGINT) AS n FROM documents
), shifted AS (
  SELECT *, greatest(len(bin(greatest(n, 1))) - 9, 0) AS shift FROM lengths
), cells AS (
  SELECT max(n) AS longest, count(*) AS docs, sum(n) AS tokens FROM shifted GROUP BY n >> shift, shift
), numbered AS (
  SELECT row_number() OVER (ORDER BY longest) AS i, longest, sum(docs) OVER (ORDER BY longest) AS docs,
    sum(tokens) OVER (ORDER BY longest) AS tokens FROM cells
), best AS (
  SELECT 1 AS layer, i, longest * docs - tokens AS cost, [longest] AS ends, [i] AS cuts FROM numbered
  UNION ALL
  SELECT layer, i, min(cost), arg_min(ends, pair), arg_min(cuts, pair)
  FROM (
    SELECT b.layer + 1 AS layer, c.i,
      b.cost + c.longest * (c.docs - a.docs) - (c.tokens - a.tokens) AS cost,
      list_append(b.ends, c.longest) AS ends, list_append(b.cuts, c.i) AS cuts,
      (b.cost + c.longest * (c.docs - a.docs) - (c.tokens - a.tokens)) * 100000 + a.i AS pair
    FROM best b JOIN numbered a ON a.i = b.i JOIN numbered c ON c.i > a.i
    WHERE b.layer < 12
  ) GROUP BY layer, i
), chosen AS (
  SELECT ends FROM best WHERE i = (SELECT max(i) FROM numbered) ORDER BY cost, layer LIMIT 1
), placed AS (
  SELECT doc_id, h, n, len(list_filter(ends, lambda e: e < n)) AS bucket,
    ends[len(list_filter(ends, lambda e: e < n)) + 1] AS padded_to
  FROM lengths, chosen
), dealt AS (
  SELECT *, h % greatest(1, (SELECT (count(*) + 1023) // 1024 FROM lengths)) AS chunk,
    greatest(1, 65536 // greatest(padded_to, 1)) AS room
  FROM placed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY chunk, doc_id NULLS FIRST, n) - 1 AS r FROM dealt
)
SELECT doc_id, n AS n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(padded_to AS BIGINT) AS padded_to,
  CAST(r // room AS BIGINT) AS batch, CAST(r % room AS INTEGER) AS slot FROM ranked
"""


SLOTS, SHARDS = 5003, [f"shard-{n:02d}" for n in range(48)]


def _owners() -> list[str]:
    """The shard of every slot, by walking each shard's list of slots from its start."""
    number = lambda text: int(md5(text.encode()).hexdigest()[:15], 16)
    lists = {
        shard: iter(
            [
                (number(f"{shard}|offset") + n * (number(f"{shard}|step") % (SLOTS - 1) + 1)) % SLOTS
                for n in range(SLOTS)
            ]
        )
        for shard in SHARDS
    }
    owners: dict[int, str] = {}
    while len(owners) < SLOTS:
        for shard, slots in lists.items():
            if len(owners) < SLOTS:
                owners[next(slot for slot in slots if slot not in owners)] = shard
    return [owners[slot] for slot in range(SLOTS)]


OP4 = f"""
WITH owners AS (SELECT unnest(string_split('{" ".join(_owners())}', ' ')) AS shard, unnest(range({SLOTS})) AS slot)
SELECT doc_id, slot, shard FROM (SELECT doc_id, {HASH} % {SLOTS} AS slot FROM documents) JOIN owners USING (slot)
"""

# Phrase and label; the first four are the base.
PHRASES = [
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"),
    ("gnu affero general public license", "agpl"), ("all rights reserved", "all-rights-reserved"),
    ("apache license version 2 0", "apache-2.0"), ("bsd license", "bsd"), ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"), ("cc by sa", "cc-by-sa"), ("cc0 1 0 universal", "cc0"),
    ("gnu general public license version 2", "gpl-2.0"), ("gnu general public license version 3", "gpl-3.0"),
    ("isc license", "isc"), ("gnu lesser general public license", "lgpl"), ("mozilla public license", "mpl"),
    ("released into the public domain", "unlicense"),
]

# Whole notices break up in files and are matched by rarity; files that hold the mandatory phrases
# of one are compared by hand in the tests. Here a file has none.
OP2 = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w, row_number() OVER () AS r FROM documents),
phrases(n, phrase, label) AS (VALUES {", ".join(f"({n}, '{p}', '{q}')" for n, (p, q) in enumerate(PHRASES))}),
listed AS (SELECT n, label, string_split(phrase, ' ') AS p FROM phrases),
places AS (
  SELECT r, n, label, i - 1 AS pos FROM docs, listed, LATERAL (SELECT unnest(range(1, len(w) - len(p) + 2)) AS i)
  WHERE list_has_all(w, p) AND w[i:i + len(p) - 1] = p
), found AS (
  SELECT r, count(*) FILTER (n < 4) AS n_base, min(pos) FILTER (n < 4) AS first_word, max(pos) FILTER (n < 4) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n < 4) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN labels IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score
FROM docs LEFT JOIN found USING (r)
"""

def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(name) for name in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


# CRC-32 of ASCII digits: each byte is mixed in, then eight times shifted (marked by -1)
CRC = """list_reduce(
  list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda d: [CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"""

OP12 = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("n_chars + 1")} AS more,
    doc_id IS NOT NULL AND xor({CRC}, 4294967295) % 7 = 0 AS tampered
  FROM documents
), placed AS (
  SELECT *, coalesce('=' || lang, '') AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), nodes AS (
  SELECT tree, 0 AS level, pos AS i, n, leaf AS hash FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2, n
), subroots AS (
  SELECT tree, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, pos AS i, n, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i))
  FROM top WHERE n > 1 GROUP BY level, i // 2, n
), paths AS (
  SELECT p.tree, p.pos, 0 AS level, p.pos AS i, p.n, '' AS given,
    CASE WHEN tampered THEN more ELSE leaf END AS folded FROM placed p
  UNION ALL
  SELECT p.tree, p.pos, p.level + 1, p.i // 2, (p.n + 1) // 2, given || coalesce(b.hash, ''),
    CASE WHEN p.i % 2 = 1 THEN sha256(b.hash || folded) ELSE sha256(folded || coalesce(b.hash, '')) END
  FROM paths p LEFT JOIN nodes b ON b.tree = p.tree AND b.level = p.level AND b.i = xor(p.i, 1) WHERE p.n > 1
), whole AS (
  SELECT p.tree, p.pos, 0 AS level, s.pos AS i, s.n, given, folded FROM paths p JOIN subroots s USING (tree) WHERE p.n = 1
  UNION ALL
  SELECT w.tree, w.pos, w.level + 1, w.i // 2, (w.n + 1) // 2, given || coalesce(b.hash, ''),
    CASE WHEN w.i % 2 = 1 THEN sha256(b.hash || folded) ELSE sha256(folded || coalesce(b.hash, '')) END
  FROM whole w LEFT JOIN top b ON b.level = w.level AND b.i = xor(w.i, 1) WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(given) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN subroots USING (tree) JOIN (SELECT tree, pos, given, folded FROM whole WHERE n = 1) w
  ON w.tree = placed.tree AND w.pos = placed.pos, (SELECT hash AS root FROM top WHERE n = 1)
"""


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS} AS w, row_number() OVER () AS r FROM documents
), places AS (SELECT lang, source, r, unnest(w) AS term FROM docs),
kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM places GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT lang, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang FROM docs)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang) USING (lang)
), cells AS (
  SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM places JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY lang, source) USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (g.total + 5 * l.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), apart AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""


ORACLES = {
    "op1_length_buckets": OP1,
    "op2_license_scan": OP2,
    "op4_shard_table": OP4,
    "op5_decontaminate": OP5,
    "op8_secret_scan": OP8,
    "op10_exact_topk": OP10,
    "op12_merkle_manifest": OP12,
    "op13_source_divergence": OP13,
}
