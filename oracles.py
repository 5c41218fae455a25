"""DuckDB SQL that computes what each registered query must return."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

# Patterns, languages and texts that results must follow, stated here once more.
SEPARATORS = r"[^\p{L}\p{N}]+"
WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|'s"
WHITESPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
LANGUAGES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
PROMPT = """You are an AI Assistant designed to answer questions based on the provided context.
Answer the question using only the context provided. If you don't know the answer or if the context doesn't contain the answer, say "I don't know based on the provided context." Keep the response informative, professional, and clear.

Context:
{context}

Question: {question}

Answer:"""
SHORT_PROMPT = """Answer the user's question using the context below. If you don't know, state that you don't know.
        
        Context:
        {context}
        
        Question: {question}
        
        Answer:"""


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def stop_words(language: str) -> list[str]:
    folder = Path(__file__).parent / "braidsearch" / "functions" / "stop_words"
    return (folder / f"{language}.txt").read_text(encoding="utf-8").split()


def simple(text: str) -> str:
    spaced = f"trim(regexp_replace(lower({text}), {quote(SEPARATORS)}, ' ', 'g'))"
    return f"list_filter(string_split({spaced}, ' '), lambda x: x <> '')"


def whitespace(text: str) -> str:
    split = f"regexp_split_to_array({text}, {quote(WHITESPACE)})"
    return f"list_filter({split}, lambda x: x <> '')"


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, {quote(f'^{WHITESPACE}|{WHITESPACE}$')}, '', 'g')"


def hex8(value: str, start: int) -> str:
    return f"('0x' || substr(md5({value}), {start}, 8))::BIGINT"


def zero(score: str) -> str:
    """Six digits, without a negative zero."""
    return f"round({score}, 6) + 0.0"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes if c) + "\n" + select.strip()


def corpus(tokens=simple) -> str:
    return f"""
ana AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS toks FROM documents),
len AS MATERIALIZED (SELECT doc_id, len(toks)::BIGINT AS dl FROM ana),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf
    FROM (SELECT doc_id, unnest(toks) AS term FROM ana) GROUP BY doc_id, term),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS MATERIALIZED (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM len)"""


def asked(tokens=simple) -> str:
    return f"""
q AS MATERIALIZED (SELECT item_id AS query_id, {trimmed('text')} AS question
    FROM benchmark WHERE length({trimmed('text')}) > 0),
qtf AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf
    FROM (SELECT query_id, unnest({tokens('question')}) AS term FROM q) GROUP BY query_id, term)"""


OKAPI_IDF = """
raw AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM df, st),
idf AS MATERIALIZED (SELECT term,
    CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""

OKAPI_SCORES = """
okapi AS MATERIALIZED (SELECT query_id, doc_id, sum(qtf * idf * (tf * 2.5::DOUBLE
        / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))) AS score
    FROM qtf JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (doc_id), st
    GROUP BY query_id, doc_id)"""

DOC_WEIGHTS = """
dw AS MATERIALIZED (SELECT doc_id, term,
        tf / (1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + tf) AS weight
    FROM tf JOIN len USING (doc_id), st)"""

QUERY_WEIGHTS = """
qidf AS (SELECT query_id, term,
        ln((n + 1::DOUBLE) / (coalesce(df, 1) + 0.5::DOUBLE)) AS idf
    FROM qtf LEFT JOIN df USING (term), st),
qw AS MATERIALIZED (SELECT query_id, term,
        idf / sum(idf) OVER (PARTITION BY query_id) AS weight FROM qidf)"""


def embedded(name: str, counted: str, key: str, count: str) -> str:
    bucket = f"{hex8('term', 1)} % 384"
    sign = f"CASE WHEN {hex8('term', 9)} % 2 = 0 THEN 1 ELSE -1 END"
    return f"""
{name}_sum AS (SELECT {key}, {bucket} AS bucket, sum(({sign}) * {count}) AS s
    FROM {counted} GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {key}, bucket,
        (s / sqrt(sum(s * s) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS value
    FROM {name}_sum WHERE s <> 0)"""


DOC_VECTORS = embedded("dv", "tf", "doc_id", "tf")
QUERY_VECTORS = embedded("qv", "qtf", "query_id", "qtf")

PAIRS = """
dots AS (SELECT query_id, doc_id, sum(qv.value * dv.value) AS dot
    FROM qv JOIN dv USING (bucket) GROUP BY query_id, doc_id),
qsq AS (SELECT query_id, sum(value * value) AS sq FROM qv GROUP BY query_id),
dsq AS (SELECT doc_id, sum(value * value) AS sq FROM dv GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT q.query_id, d.doc_id, coalesce(dot, 0) AS dot,
        greatest(coalesce(qsq.sq, 0) + coalesce(dsq.sq, 0) - 2 * coalesce(dot, 0), 0) AS l2
    FROM q CROSS JOIN documents d
    LEFT JOIN dots ON dots.query_id = q.query_id AND dots.doc_id = d.doc_id
    LEFT JOIN qsq ON qsq.query_id = q.query_id
    LEFT JOIN dsq ON dsq.doc_id = d.doc_id)"""


def ranked(name: str, source: str, score: str, k: int, order: str = "DESC") -> str:
    return f"""
{name} AS MATERIALIZED (SELECT query_id, doc_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, doc_id) AS rank
    FROM (SELECT query_id, doc_id, {zero(score)} AS score FROM {source}))
    WHERE rank <= {k})"""


PADDED_SOURCE = """
allok AS (SELECT q.query_id, d.doc_id, coalesce(o.score, 0) AS score
    FROM q CROSS JOIN documents d
    LEFT JOIN okapi o ON o.query_id = q.query_id AND o.doc_id = d.doc_id)"""

CONVEX_SOURCE = """
sparse AS (SELECT query_id, doc_id, sum(qw.weight * dw.weight) AS s
    FROM qw JOIN dw USING (term) GROUP BY query_id, doc_id),
convex AS (SELECT p.query_id, p.doc_id, 0.5::DOUBLE * dot + 0.5::DOUBLE * coalesce(s, 0) AS score
    FROM pairs p LEFT JOIN sparse s ON s.query_id = p.query_id AND s.doc_id = p.doc_id)"""


def fused(lists: list[tuple[str, float]]) -> str:
    union = " UNION ALL ".join(
        f"SELECT query_id, doc_id, rank, {n} AS list_no, {w}::DOUBLE AS w FROM {name}"
        for n, (name, w) in enumerate(lists)
    )
    return f"""
entries AS ({union}),
merged AS (SELECT query_id, sha256(text) AS content_id, sum(w / (60 + rank)) AS score,
        arg_min(doc_id, list_no * 1000000 + rank) AS doc_id,
        min(list_no * 1000000 + rank) AS seen
    FROM entries JOIN documents USING (doc_id) GROUP BY query_id, content_id),
fused AS MATERIALIZED (SELECT query_id, doc_id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank
    FROM (SELECT query_id, doc_id, {zero('score')} AS score, seen FROM merged))"""


SPARSE = (corpus(), asked(), OKAPI_IDF, OKAPI_SCORES)
DENSE = (DOC_VECTORS, QUERY_VECTORS, PAIRS)
ENSEMBLE = (
    *SPARSE, PADDED_SOURCE, ranked("padded", "allok", "score", 5),
    *DENSE, ranked("near", "pairs", "l2", 5, "ASC"),
    fused([("padded", 0.5), ("near", 0.5)]),
)
HYBRID = (
    corpus(), asked(), DOC_WEIGHTS, QUERY_WEIGHTS, *DENSE, CONVEX_SOURCE,
    ranked("hybrid", "convex", "score", 3),
)


def adjacent(tokens: str) -> str:
    return f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1])"


def share(wanted: str, found: str) -> str:
    distinct = f"list_distinct({wanted})"
    return f"len(list_intersect({distinct}, {found}))::DOUBLE / greatest(len({distinct}), 1)"


RERANKED = f"""
worded AS MATERIALIZED (SELECT f.query_id, f.doc_id, f.rank AS earlier,
        {simple('q.question')} AS qt, {simple('d.text')} AS dt
    FROM fused f JOIN q USING (query_id) JOIN documents d USING (doc_id)),
paired AS MATERIALIZED (SELECT *, {adjacent('qt')} AS qb, {adjacent('dt')} AS db FROM worded),
rel AS MATERIALIZED (SELECT query_id, doc_id, earlier,
        {zero(f"0.6::DOUBLE * {share('qt', 'dt')} + 0.4::DOUBLE * {share('qb', 'db')}")}
            AS relevance_score
    FROM paired),
top AS MATERIALIZED (SELECT query_id, doc_id, relevance_score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY relevance_score DESC, earlier) AS rank FROM rel)
    WHERE rank <= 3 AND relevance_score >= 0)"""

META = """
meta AS (SELECT doc_id, text,
        CASE WHEN lang <> 'fr' THEN source || '#' || doc_id END AS title,
        CASE WHEN lang <> 'de' THEN lang END AS category FROM documents)"""

ENTRY = (
    "'[' || rank || '] Source: ' || coalesce(title, 'Untitled Document') || ' (Category: ' "
    "|| coalesce(category, 'General') || ')' || chr(10) || 'Content: ' || coalesce(text, '')"
)


def contexts(ranked_list: str, entry: str) -> str:
    return f"""{META},
ctx AS MATERIALIZED (SELECT query_id, string_agg({entry}, chr(10) || chr(10) ORDER BY rank)
        AS context, count(*) AS n_sources
    FROM {ranked_list} JOIN meta USING (doc_id) GROUP BY query_id)"""


def prompted(template: str) -> str:
    head, rest = template.split("{context}")
    middle, tail = rest.split("{question}")
    return f"""SELECT query_id, {quote(head)} || coalesce(context, '') || {quote(middle)}
        || question || {quote(tail)} AS prompt, coalesce(n_sources, 0) AS n_sources
    FROM q LEFT JOIN ctx USING (query_id)"""


def words(stem: bool) -> str:
    stops = " UNION ALL ".join(
        f"SELECT '{code}' AS lang, unnest([{', '.join(map(quote, stop_words(name)))}]) AS term"
        for code, name in LANGUAGES.items()
    )
    term = "term"
    if stem:
        term = """CASE WHEN term = '''s' THEN term
            WHEN ends_with(term, 'ies') THEN left(term, length(term) - 3) || 'y'
            WHEN ends_with(term, 'sses') THEN left(term, length(term) - 2)
            WHEN ends_with(term, 'ss') OR ends_with(term, 'us') THEN term
            WHEN ends_with(term, 's') THEN left(term, length(term) - 1) ELSE term END"""
    return query(
        f"stop AS (SELECT DISTINCT * FROM ({stops}))",
        f"""tok AS (SELECT doc_id, lang,
            unnest(regexp_extract_all(lower(text), {quote(WORD)}, 0)) AS term FROM documents)""",
        "kept AS (SELECT doc_id, term FROM tok ANTI JOIN stop USING (lang, term))",
        select=f"SELECT doc_id, {term} AS term, count(*) AS tf FROM kept GROUP BY ALL",
    )


def murmur(words: str, tail: str, n: str) -> str:
    """32-bit Murmur3 with seed 0 of 4-byte words, the number made of the bytes left, and the length."""

    def whole(x: str) -> str:
        return f"(({x}) & 4294967295::UBIGINT)"

    def rotate(x: str, bits: int) -> str:
        return whole(f"(({x}) << {bits}) | (({x}) >> {32 - bits})")

    def mix(x: str) -> str:
        scrambled = rotate(whole(f"{x} * 3432918353::UBIGINT"), 15)
        return whole(f"{scrambled} * 461845907::UBIGINT")

    step = whole(f"{rotate(f'xor(h, {mix("w")})', 13)} * 5 + 3864292196::UBIGINT")
    state = f"list_reduce({words}, lambda h, w: {step}, 0::UBIGINT)"
    state = f"xor(xor({state}, {mix(tail)}), {n})"
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        state = f"[{state}]::UBIGINT[]"
        state = f"list_transform({state}, lambda x: {whole(f'xor(x, x >> {shift}) * {factor}::UBIGINT')})[1]"
    return f"list_transform([{state}]::UBIGINT[], lambda x: xor(x, x >> 16))[1]::BIGINT"


MURMUR = f"""
raw_bytes AS (SELECT term, df, hex(encode(term)) AS digits FROM df),
bytes AS (SELECT term, df, list_transform(range(0, length(digits) // 2),
        lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::UBIGINT) AS b FROM raw_bytes),
hashed_words AS MATERIALIZED (SELECT term, df, len(b)::UBIGINT AS n,
        list_transform(range(0, len(b) // 4), lambda j: b[4 * j + 1] + b[4 * j + 2] * 256
            + b[4 * j + 3] * 65536 + b[4 * j + 4] * 16777216)::UBIGINT[] AS words,
        list_sum(list_transform(range(0, len(b) % 4),
            lambda j: b[len(b) // 4 * 4 + j + 1] << (8 * j))) AS tail
    FROM bytes),
ids AS (SELECT term, df, {murmur('words', 'coalesce(tail, 0)::UBIGINT', 'n')} AS term_id
    FROM hashed_words)"""

CENTROIDS = """
vec AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
cells AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(v) AS x FROM vec),
cent AS MATERIALIZED (SELECT query_id, list(m ORDER BY pos) AS c FROM (
    SELECT label::BIGINT AS query_id, pos, avg(x) AS m FROM cells GROUP BY ALL) GROUP BY query_id)"""

CENTROID_DOT = """
scored AS (SELECT query_id, vec_id AS doc_id, list_dot_product(c, v) AS score FROM cent, vec)"""

CENTROID_L2 = """
scored AS (SELECT query_id, vec_id AS doc_id, list_sum(list_transform(range(1, 65),
        lambda i: (c[i] - v[i]) * (c[i] - v[i]))) AS score FROM cent, vec)"""

LSH_BUCKETS = """
planes AS MATERIALIZED (SELECT p, list(1 - 2 * (('0x' || substr(md5(p || ':' || d), 1, 8))::BIGINT % 2)
        ORDER BY d)::DOUBLE[] AS plane
    FROM range(120) a(p), range(64) b(d) GROUP BY p),
vb AS (SELECT vec_id, p // 10 AS t,
        sum(CASE WHEN list_dot_product(v, plane) >= 0 THEN 1 << (p % 10) ELSE 0 END)::BIGINT AS b
    FROM vec, planes GROUP BY ALL),
cb AS (SELECT query_id, p // 10 AS t,
        sum(CASE WHEN list_dot_product(c, plane) >= 0 THEN 1 << (p % 10) ELSE 0 END)::BIGINT AS b
    FROM cent, planes GROUP BY ALL),
met AS (SELECT DISTINCT query_id, vec_id FROM cb JOIN vb USING (t) WHERE bit_count(xor(cb.b, vb.b)) <= 2),
scored AS (SELECT query_id, vec_id AS doc_id, list_dot_product(c, v) AS score
    FROM met JOIN cent USING (query_id) JOIN vec USING (vec_id))"""

BY_VECTOR = "SELECT query_id, doc_id AS vec_id, score, rank FROM best"

SOURCE = """SELECT doc_id, text AS page_content, source || '#' || doc_id AS title,
    lang AS category FROM documents"""
RANKED = "SELECT query_id, doc_id, score, rank FROM "
NEWEST = """SELECT max(doc_id) AS doc_id, sha256(any_value(text)) AS content_id,
    any_value(text) AS text FROM documents GROUP BY text"""

TWO_BATCHES = f"""
batches AS (SELECT doc_id, text, lang NOT IN ('en', 'fr') AS second FROM documents),
latest AS MATERIALIZED (SELECT text,
        coalesce(max(doc_id) FILTER (second), max(doc_id)) AS doc_id,
        CASE WHEN bool_or(second) THEN count(*) FILTER (second) ELSE count(*) END AS copies
    FROM batches GROUP BY text),
ana AS MATERIALIZED (SELECT doc_id, copies, {simple('text')} AS toks FROM latest),
len AS MATERIALIZED (SELECT doc_id, copies, len(toks)::BIGINT AS dl FROM ana),
tf AS MATERIALIZED (SELECT doc_id, copies, term, count(*) AS tf
    FROM (SELECT doc_id, copies, unnest(toks) AS term FROM ana) GROUP BY ALL),
df AS MATERIALIZED (SELECT term, sum(copies)::BIGINT AS df FROM tf GROUP BY term),
st AS MATERIALIZED (SELECT sum(copies)::BIGINT AS n, sum(dl * copies)::DOUBLE / sum(copies) AS avgdl
    FROM len)"""

ORACLES: dict[str, Callable[[], str]] = {
    "doc_source": lambda: SOURCE,
    "corpus_roundtrip": lambda: SOURCE,
    "bm25_model_roundtrip": lambda: query(corpus(), select="SELECT term, df FROM df"),
    "collection_upsert": lambda: """WITH two AS (SELECT sha256(text) AS content_id,
        coalesce(max(doc_id) FILTER (lang = 'en'), max(doc_id)) AS doc_id,
        CASE WHEN count(*) FILTER (lang = 'en') > 0 THEN 'updated'
            ELSE arg_max(lang, doc_id) END AS category
        FROM documents GROUP BY text),
        three AS (SELECT sha256(text || ' (new)') AS content_id, max(doc_id) AS doc_id, 'third' AS category
        FROM documents WHERE lang = 'fr' GROUP BY text)
        SELECT * FROM two WHERE doc_id NOT IN (SELECT doc_id FROM three) UNION ALL SELECT * FROM three""",
    "bm25_model_json": lambda: query(corpus(), MURMUR, select="SELECT term_id, df FROM ids"),
    "ingest_two_batches": lambda: query(
        TWO_BATCHES, asked(), OKAPI_IDF, OKAPI_SCORES, ranked("best", "okapi", "score", 5),
        select=RANKED + "best",
    ),
    "collection_rebuild": lambda: "SELECT doc_id, sha256(text) AS content_id FROM documents",
    "ingest_report": lambda: """SELECT count(*) AS n_ingested,
        count(DISTINCT text) AS n_distinct_content FROM documents""",
    "ingest_upsert": lambda: f"""SELECT doc_id, len(list_distinct({simple('text')}))::BIGINT AS n_terms,
        384::BIGINT AS dim FROM ({NEWEST})""",
    "ingest_rebuild": lambda: f"""SELECT doc_id, len(list_distinct({simple('text')}))::BIGINT AS n_terms,
        384::BIGINT AS dim FROM documents""",
    "question_clean": lambda: f"""SELECT conv_id, turn, {trimmed('text')} AS question FROM conversations
        WHERE role = 'user' AND length({trimmed('text')}) > 0""",
    "tokens_word": lambda: words(stem=False),
    "tokens_stemmed": lambda: words(stem=True),
    "term_ids": lambda: query(corpus(), select=f"SELECT term, {hex8('term', 1)} AS term_id FROM df"),
    "term_ids_murmur": lambda: query(corpus(), MURMUR, select="SELECT term, term_id FROM ids"),
    "vocab_top10": lambda: query(
        corpus(), select="SELECT term, df FROM df ORDER BY df DESC, term LIMIT 10"
    ),
    "term_freq": lambda: query(corpus(), select="SELECT doc_id, term, tf FROM tf"),
    "doc_lengths": lambda: query(corpus(), select="SELECT doc_id, dl FROM len"),
    "doc_freq": lambda: query(corpus(), select="SELECT term, df FROM df"),
    "vocab_size": lambda: query(corpus(), select="SELECT count(*) AS n_terms FROM df"),
    "bm25_stats": lambda: query(corpus(), select="SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM st"),
    "bm25_fit": lambda: query(
        corpus(),
        select="""SELECT any_value(n) AS n_docs, round(any_value(avgdl), 6) AS avgdl,
            count(*) AS n_terms, sum(df)::BIGINT AS sum_df FROM df, st""",
    ),
    "okapi_idf": lambda: query(corpus(), OKAPI_IDF, select=f"SELECT term, {zero('idf')} AS idf FROM idf"),
    "sparse_doc_vector": lambda: query(
        corpus(), DOC_WEIGHTS,
        select="SELECT doc_id AS id, term, round(weight, 6) AS weight FROM dw",
    ),
    "sparse_query_vector": lambda: query(
        corpus(), asked(), QUERY_WEIGHTS,
        select="SELECT query_id AS id, term, round(weight, 6) AS weight FROM qw",
    ),
    "bm25_okapi_topk": lambda: query(
        *SPARSE, ranked("best", "okapi", "score", 5), select=RANKED + "best"
    ),
    "bm25_blockmax_topk": lambda: query(
        *SPARSE, ranked("best", "okapi", "score", 5), select=RANKED + "best"
    ),
    "bm25_padded_topk": lambda: query(
        *SPARSE, PADDED_SOURCE, ranked("best", "allok", "score", 5), select=RANKED + "best"
    ),
    "bm25_whitespace_topk": lambda: query(
        corpus(whitespace), asked(whitespace), OKAPI_IDF, OKAPI_SCORES, PADDED_SOURCE,
        ranked("best", "allok", "score", 5), select=RANKED + "best",
    ),
    "vector_profile": lambda: """SELECT vec_id, len(embedding)::BIGINT AS dim,
        array_to_string(list_transform(embedding[1:10], lambda x: printf('%.4f', x::DOUBLE)), ',')
            AS first_values,
        round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm
        FROM embeddings""",
    "hash_embed_docs": lambda: query(
        corpus(), DOC_VECTORS,
        select=f"SELECT doc_id AS id, bucket, {zero('value')} AS value FROM dv",
    ),
    "hash_embed_queries": lambda: query(
        asked(), QUERY_VECTORS,
        select=f"SELECT query_id AS id, bucket, {zero('value')} AS value FROM qv",
    ),
    "dense_dot_topk": lambda: query(
        CENTROIDS, CENTROID_DOT, ranked("best", "scored", "score", 5), select=BY_VECTOR
    ),
    "dense_l2_topk": lambda: query(
        CENTROIDS, CENTROID_L2, ranked("best", "scored", "score", 5, "ASC"), select=BY_VECTOR
    ),
    "dense_lsh_topk": lambda: query(
        CENTROIDS, LSH_BUCKETS, ranked("best", "scored", "score", 5), select=BY_VECTOR
    ),
    "dense_text_topk": lambda: query(
        corpus(), asked(), *DENSE, ranked("best", "pairs", "dot", 5), select=RANKED + "best"
    ),
    "hybrid_convex_topk": lambda: query(*HYBRID, select=RANKED + "hybrid"),
    "hybrid_threshold_topk": lambda: query(*HYBRID, select=RANKED + "hybrid"),
    "rrf_fusion": lambda: query(*ENSEMBLE, select=RANKED + "fused"),
    "rrf_weighted": lambda: query(
        *SPARSE, ranked("sparsetop", "okapi", "score", 5),
        *DENSE, ranked("near", "pairs", "l2", 5, "ASC"),
        DOC_WEIGHTS, QUERY_WEIGHTS, CONVEX_SOURCE, ranked("hybrid", "convex", "score", 3),
        fused([("sparsetop", 0.5), ("near", 0.3), ("hybrid", 0.2)]), select=RANKED + "fused",
    ),
    "rerank_scores": lambda: query(
        *ENSEMBLE, RERANKED, select="SELECT query_id, doc_id, relevance_score FROM rel"
    ),
    "rerank_topn": lambda: query(
        *ENSEMBLE, RERANKED, select="SELECT query_id, doc_id, relevance_score, rank FROM top"
    ),
    "context_block": lambda: query(
        *HYBRID, contexts("hybrid", ENTRY), select="SELECT query_id, context FROM ctx"
    ),
    "citations": lambda: query(
        *ENSEMBLE, RERANKED, META,
        select="""SELECT query_id, rank, coalesce(title, 'Unknown') AS title,
            coalesce(category, 'Unknown') AS category,
            printf('%.4f', relevance_score) AS score_text,
            replace(substr(coalesce(text, ''), 1, 150), chr(10), ' ') || '...' AS snippet
            FROM top JOIN meta USING (doc_id)""",
    ),
    "rag_prompt_batch": lambda: query(*HYBRID, contexts("hybrid", ENTRY), select=prompted(PROMPT)),
    "rag_prompt_stuff": lambda: query(
        *HYBRID, contexts("hybrid", "coalesce(text, '')"), select=prompted(SHORT_PROMPT)
    ),
    "rag_rerank_prompt_batch": lambda: query(
        *ENSEMBLE, RERANKED, contexts("top", ENTRY), select=prompted(PROMPT)
    ),
}


def built() -> dict[str, str]:
    """The SQL of every query; one that cannot be built is left out and named."""
    found = {}
    for name, build in ORACLES.items():
        try:
            found[name] = build()
        except Exception as error:
            print(f"no SQL for {name}: {error!r}", file=sys.stderr)
    return found
