"""Registered queries of the library's operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpie.functions import paths, sparse, text
from kelpie.operators import chunking, evidence, graph, impacts, messaging, resolve, retrieval
from kelpie.plans import fixtures
from kelpie.sources import projects, scan, trace
from kelpie.sources.cache import EmbeddingCache
from kelpie.sources.graph_state import GraphState
from kelpie.sources.store import shared_folder, stored

WORD_QUERIES = [(0, "the of and tion"), (1, "der und lich"), (2, "que del ciones"), (3, "idiot worthless"), (4, "erer thing on")]
SUBSTRING_QUERIES = [(0, "the "), (1, '"thing"'), (2, "und der"), (3, "Licensed under")]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# SQL pieces
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
FOLD = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 32, 4), lambda i: ('0x' || substr(md5(token), i, 4))::BIGINT)), lambda a, x: (a * 65536 + x) % 30000)::INTEGER"
POSTINGS = f"""
words AS (SELECT doc_id, unnest({TOKENS}) AS token FROM documents),
tf1 AS (SELECT doc_id, token, count(*) AS n FROM words GROUP BY ALL),
terms AS (SELECT token, {FOLD} AS term FROM (SELECT DISTINCT token FROM words)),
postings AS (SELECT doc_id, term, sum(n)::BIGINT AS tf FROM tf1 JOIN terms USING (token) GROUP BY ALL),
idf AS (SELECT term, count(*)::BIGINT AS df,
               round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) * 1000000)::BIGINT AS idf_q
        FROM postings GROUP BY term)"""


def values(rows, names: str) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


def keyword_sql(k: int, where: str = "true", queries: list[tuple[int, str]] = WORD_QUERIES) -> str:
    return f"""
WITH {POSTINGS},
qwords AS (SELECT query_ord, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM {values(queries, 'query_ord, query')}),
qterms AS (SELECT query_ord, {FOLD} AS term, count(*) AS q_tf FROM qwords GROUP BY ALL),
scores AS (SELECT query_ord, doc_id, sum(q_tf * idf_q * tf)::BIGINT AS score
           FROM postings JOIN qterms USING (term) JOIN idf USING (term)
           WHERE doc_id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY ALL),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_ord ORDER BY score DESC, doc_id) AS rank FROM scores),
hits AS (SELECT query_ord::INTEGER AS query_ord, doc_id, score, rank::INTEGER AS rank FROM keyword WHERE rank <= {k})"""


def built(spark: SparkSession, sf_dir: str, queries: list[tuple[int, str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, postings and idf; of queries' terms alone where they are given, which is all that these read."""
    docs = fixtures.documents(spark, sf_dir)
    only = None if queries is None else {sparse.term_number_of(t) for _, q in queries for t in sparse.tokens_of(q)}
    postings = stored(sparse.postings(docs, "doc_id", "text", only), "postings")
    return docs, postings, sparse.idf(postings, "doc_id", docs.count())


@query(
    "token_stats",
    f"""SELECT lang, count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_tokens, max(len(t))::BIGINT AS most, sum(length(coalesce(text, '')) // 4)::BIGINT AS n_estimated
FROM (SELECT lang, text, {TOKENS} AS t FROM documents) GROUP BY lang""",
)
def token_stats(spark, sf_dir):
    docs = fixtures.documents(spark, sf_dir)
    n = F.size(sparse.tokens("text")).cast("long")
    return docs.select("lang", n.alias("n"), text.token_estimate("text").alias("e")).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("most"), F.sum("e").alias("n_estimated"))


@query("sparse_index", f"WITH {POSTINGS} SELECT doc_id, term, tf FROM postings")
def sparse_index(spark, sf_dir):
    return sparse.postings(fixtures.documents(spark, sf_dir), "doc_id", "text")


@query("idf_table", f"WITH {POSTINGS} SELECT term, df, idf_q FROM idf")
def idf_table(spark, sf_dir):
    return built(spark, sf_dir)[2]


@query("keyword_topk", keyword_sql(10) + " SELECT * FROM hits")
def keyword_topk(spark, sf_dir):
    _, postings, idf = built(spark, sf_dir, WORD_QUERIES)
    return retrieval.keyword_top_k(postings, idf, retrieval.query_terms(spark, WORD_QUERIES), "doc_id", 10)


@query("filtered_topk", keyword_sql(10, "lang IN ('en', 'de') AND source = 'src0'") + " SELECT * FROM hits")
def filtered_topk(spark, sf_dir):
    docs, postings, idf = built(spark, sf_dir, WORD_QUERIES)
    allowed = docs.filter(retrieval.filters({"lang": ["en", "de"], "source": "src0", "doc_id": None})).select("doc_id")
    own = postings.join(allowed, "doc_id", "left_semi")
    return retrieval.keyword_top_k(own, idf, retrieval.query_terms(spark, WORD_QUERIES), "doc_id", 10)


def cosine_sql(k: int) -> str:
    return f"""
cosine AS (SELECT q.vec_id AS query_ord, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score
           FROM embeddings q, embeddings e WHERE q.vec_id < 10),
semantic AS (SELECT query_ord::INTEGER AS query_ord, vec_id, score, (row_number() OVER (PARTITION BY query_ord ORDER BY score DESC, vec_id))::INTEGER AS rank FROM cosine)"""


def query_vectors(spark, sf_dir):
    e = fixtures.read(spark, sf_dir, "embeddings")
    return e, [(r["vec_id"], r["embedding"]) for r in e.filter("vec_id < 10").collect()]  # ten stated queries


@query("semantic_topk", f"WITH {cosine_sql(10)} SELECT * FROM semantic WHERE rank <= 10")
def semantic_topk(spark, sf_dir):
    e, q = query_vectors(spark, sf_dir)
    return retrieval.semantic_top_k(e, "vec_id", "embedding", q, 10)


@query(
    "hybrid_rrf",
    keyword_sql(50)
    + f""", {cosine_sql(50)},
legs AS (SELECT query_ord, doc_id, rank FROM hits UNION ALL SELECT query_ord, vec_id AS doc_id, rank FROM semantic WHERE rank <= 50 AND query_ord < 5),
fused AS (SELECT query_ord, doc_id, round(sum(1 / (60.0 + rank)::DOUBLE), 9) AS score FROM legs GROUP BY ALL)
SELECT * FROM (SELECT query_ord, doc_id, score, (row_number() OVER (PARTITION BY query_ord ORDER BY score DESC, doc_id))::INTEGER AS rank FROM fused) WHERE rank <= 20""",
)
def hybrid_rrf(spark, sf_dir):
    """Terms over documents and vectors over embeddings, whose ids are taken to be the same things."""
    _, postings, idf = built(spark, sf_dir, WORD_QUERIES)
    e, q = query_vectors(spark, sf_dir)
    words = retrieval.keyword_top_k(postings, idf, retrieval.query_terms(spark, WORD_QUERIES), "doc_id", 50)
    near = retrieval.semantic_top_k(e, "vec_id", "embedding", [x for x in q if x[0] < 5], 50).withColumnRenamed("vec_id", "doc_id")
    return retrieval.reciprocal_rank_fusion([words, near], "doc_id", 20)


@query(
    "exact_search",
    keyword_sql(20, queries=SUBSTRING_QUERIES)
    + f""", needles AS (SELECT query_ord, lower(trim(query, '"''`')) AS needle FROM {values(SUBSTRING_QUERIES, 'query_ord, query')}),
found AS (SELECT query_ord, doc_id, rank, contains(lower(text), needle) AS exact_match FROM hits JOIN needles USING (query_ord) JOIN documents USING (doc_id)),
counted AS (SELECT *, count_if(exact_match) OVER (PARTITION BY query_ord) AS n FROM found),
placed AS (SELECT query_ord, doc_id, exact_match, (row_number() OVER (PARTITION BY query_ord ORDER BY exact_match DESC, rank, doc_id))::INTEGER AS place FROM counted WHERE exact_match OR n < 5)
SELECT query_ord, doc_id, exact_match, place AS rank FROM placed WHERE place <= 10""",
)
def exact_search(spark, sf_dir):
    """Each query's own candidates by its words, those first whose whole text holds it as it stands."""
    docs, postings, idf = built(spark, sf_dir, SUBSTRING_QUERIES)
    hits = retrieval.keyword_top_k(postings, idf, retrieval.query_terms(spark, SUBSTRING_QUERIES), "doc_id", 20)
    return retrieval.exact_top_k(hits, docs, "doc_id", SUBSTRING_QUERIES, 10)


@query(
    "learned_topk",
    rf"""WITH words AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents),
features AS (SELECT doc_id, w AS token FROM words UNION ALL SELECT doc_id, '~' || left(w, 4) FROM words WHERE length(w) > 4),
tf AS (SELECT doc_id, token, count(*) AS n FROM features GROUP BY ALL),
terms AS (SELECT token, {FOLD} AS term FROM (SELECT DISTINCT token FROM features)),
impacts AS (SELECT doc_id, term, least(255, sum(least(255, greatest(1, round(32 * (CASE WHEN token LIKE '~%' THEN 0.5::DOUBLE ELSE 1 END) * ln(1 + n))))))::BIGINT AS impact FROM tf JOIN terms USING (token) GROUP BY ALL),
qwords AS (SELECT query_ord, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS w FROM {values(WORD_QUERIES, 'query_ord, query')}),
qfeatures AS (SELECT query_ord, w AS token FROM qwords UNION ALL SELECT query_ord, '~' || left(w, 4) FROM qwords WHERE length(w) > 4),
qtf AS (SELECT query_ord, token, count(*) AS n FROM qfeatures GROUP BY ALL),
weights AS (SELECT query_ord, {FOLD} AS term, least(255, sum(least(255, greatest(1, round(32 * (CASE WHEN token LIKE '~%' THEN 0.5::DOUBLE ELSE 1 END) * ln(1 + n))))))::BIGINT AS weight FROM qtf GROUP BY ALL),
scored AS (SELECT query_ord, doc_id, sum(weight * impact)::BIGINT AS score FROM impacts JOIN weights USING (term) GROUP BY ALL),
ranked AS (SELECT query_ord::INTEGER AS query_ord, doc_id, score, (row_number() OVER (PARTITION BY query_ord ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scored)
SELECT * FROM ranked WHERE rank <= 10""",
)
def learned_topk(spark, sf_dir):
    """The best documents by expanded, quantised vectors; blocks that can't reach the best ten stay closed."""
    index = impacts.build(impacts.impact_postings(fixtures.documents(spark, sf_dir), "doc_id", "text"), "doc_id")
    return impacts.impact_top_k(index, impacts.query_impacts(spark, WORD_QUERIES), 10)


@query(
    "batch_merge",
    keyword_sql(30)
    + """, firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_ord, rank) AS n FROM hits)
SELECT query_ord, doc_id, score, rank FROM firsts WHERE n = 1""",
)
def batch_merge(spark, sf_dir):
    _, postings, idf = built(spark, sf_dir, WORD_QUERIES)
    return retrieval.merge(retrieval.keyword_top_k(postings, idf, retrieval.query_terms(spark, WORD_QUERIES), "doc_id", 30), "doc_id")


@query(
    "simple_rerank",
    keyword_sql(60)
    + """, scored AS (SELECT doc_id, round(score / 1000000.0 + 0.1 * len(list_filter(['and', 'of', 'the', 'tion'], lambda t: contains(lower(text), t)))
                 + CASE WHEN contains(lower(text), 'the of and tion') THEN 0.3 ELSE 0.0 END, 6) AS score_rerank
          FROM hits JOIN documents USING (doc_id) WHERE query_ord = 0)
SELECT doc_id, score_rerank FROM scored ORDER BY score_rerank DESC, doc_id LIMIT 20""",
)
def simple_rerank(spark, sf_dir):
    docs, postings, idf = built(spark, sf_dir, WORD_QUERIES)
    hits = retrieval.keyword_top_k(postings, idf, retrieval.query_terms(spark, WORD_QUERIES[:1]), "doc_id", 60)
    hits = hits.withColumn("score", F.col("score") / 1_000_000.0).join(docs.select("doc_id", "text"), "doc_id")
    return retrieval.simple_rerank(hits, WORD_QUERIES[0][1]).select("doc_id", "score_rerank")


# Text functions; DuckDB's classes are ASCII, and so is the tables' white space.
LINES = r"""array_to_string(list_transform(string_split(trim(coalesce(text, ''), E' \n\t\r'), chr(10)), lambda x: regexp_replace(x, '^\s*\d+[\s:|\-]+\s*', '')), ' ')"""
STEP = rf"""regexp_replace(regexp_replace(regexp_replace({LINES}, '\s+', ' ', 'g'), '\d{{4}}-\d{{2}}-\d{{2}}[T\s]\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?', '', 'g'), '\d{{4}}-\d{{2}}-\d{{2}}', '', 'g')"""
FINGERPRINT = rf"""
normal AS (SELECT *, {STEP} AS s FROM SOURCE),
cut AS (SELECT * EXCLUDE s, trim(CASE WHEN length(s) > 200 THEN left(s, 100) || right(s, 100) ELSE s END) AS norm FROM normal),
printed AS (SELECT * EXCLUDE norm, substr(md5(coalesce(nullif(norm, ''), nullif(substr(trim(coalesce(text, ''), E' \n\t\r'), 1, 200), ''), id || ':' || path)), 1, 16) AS fingerprint FROM cut)"""


def fingerprint_sql(source: str) -> str:
    return FINGERPRINT.replace("SOURCE", source)


@query(
    "fingerprints",
    f"WITH {fingerprint_sql('(SELECT doc_id, text, doc_id::VARCHAR AS id, source AS path FROM documents)')} SELECT doc_id, fingerprint FROM printed",
)
def fingerprints(spark, sf_dir):
    return fixtures.documents(spark, sf_dir).select("doc_id", text.fingerprint("text", F.col("doc_id").cast("string"), F.col("source")).alias("fingerprint"))


@query(
    "snippets",
    r"""SELECT doc_id, CASE WHEN length(s) <= 200 THEN s ELSE substr(s, 1, 197) || '...' END AS snippet, substr(sha256(coalesce(text, '')), 1, 16) AS content_hash,
list_has_any([1], list_transform(['update','change','transition','set','modify','trigger','call','invoke','execute','retry','timeout','handle','process','create','delete','insert','save'], lambda v: contains(lower(coalesce(text, '')), v)::INTEGER)) AS causal
FROM (SELECT doc_id, text, regexp_replace(trim(coalesce(text, ''), E' \n\t\r'), '\s+', ' ', 'g') AS s FROM documents)""",
)
def snippets(spark, sf_dir):
    return fixtures.documents(spark, sf_dir).select("doc_id", text.snippet("text").alias("snippet"), text.content_hash("text").alias("content_hash"), text.has_causal_verb("text").alias("causal"))


TAG_LIST = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{k}' END" for k, p in text.TAG_PATTERNS.items()) + "], lambda x: x IS NOT NULL))"


@query("content_tags", f"SELECT doc_id, array_to_string({TAG_LIST}, ',') AS tags FROM documents")
def content_tags(spark, sf_dir):
    return fixtures.documents(spark, sf_dir).select("doc_id", F.array_join(text.tags("text", F.lit("")), ",").alias("tags"))


@query("named_entities")
def named_entities(spark, sf_dir):
    e = text.named_entities("text")
    return fixtures.documents(spark, sf_dir).select("doc_id", e.alias("e")).select("doc_id", *(F.array_join(f"e.{k}", ",").alias(k) for k in ("config_keys", "enums", "constants")))



@query(
    "source_kinds",
    r"""SELECT page_id, CASE WHEN p LIKE '%.sql' THEN 'sql' WHEN regexp_matches(p, '\.(md|txt|rst)$') THEN 'doc' WHEN regexp_matches(p, '\.(yaml|yml|json|xml|config)$') OR contains(p, 'config') OR contains(p, 'appsettings') THEN 'config'
WHEN contains(p, 'jira') OR contains(p, 'issue') THEN 'jira' WHEN contains(p, 'knowledge') OR contains(p, 'docs/') THEN 'doc' ELSE 'code' END AS kind FROM (SELECT page_id, lower(url) AS p FROM pages)""",
)
def source_kinds(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "pages").select("page_id", text.source_kind("url").alias("kind"))


@query(
    "module_keys",
    """SELECT page_id, CASE WHEN url = '' THEN 'unknown'
WHEN len(list_filter(range(1, len(p) + 1), lambda i: p[i] IN ('services', 'apps', 'packages', 'libs', 'service') AND i < len(p))) > 0 THEN 'top'
WHEN len(list_filter(p, lambda x: contains(x, '.') AND regexp_matches(x, '^[A-Z]') AND NOT regexp_matches(x, '[.](cs|py|js|ts)$'))) > 0 THEN list_filter(p, lambda x: contains(x, '.') AND regexp_matches(x, '^[A-Z]') AND NOT regexp_matches(x, '[.](cs|py|js|ts)$'))[1]
ELSE array_to_string(p[1:3], '/') END AS module FROM (SELECT page_id, url, string_split(url, '/') AS p FROM pages)""",
)
def module_keys(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "pages").select("page_id", paths.module_key("url").alias("module"))


CARDS = rf"""
base AS (SELECT doc_id, text, doc_id::VARCHAR AS id, 'apps/' || source || '/src/main/' || lang || '/' || doc_id || '.txt' AS path, source, lang FROM documents),
{fingerprint_sql('base')},
cards AS (SELECT id, path, text AS chunk_text, fingerprint, list_sort(list_distinct(list_concat({TAG_LIST}, ['t' || doc_id % 11, 's' || source]))) AS tags,
  ['code', 'doc', 'config', 'sql'][doc_id % 7 % 4 + 1] AS source_kind, (doc_id * 7919) % 1000 / 1000.0::DOUBLE AS score_rerank,
  (regexp_extract(source, '(\d+)', 1)::INTEGER % 3)::INTEGER AS round_found, doc_id AS ord FROM printed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score_rerank DESC, round_found, ord) AS best,
  first_value(round_found) OVER w AS first_round, first_value(ord) OVER w AS first_ord FROM cards WINDOW w AS (PARTITION BY fingerprint ORDER BY round_found, ord)),
pool AS (SELECT id, path, chunk_text, fingerprint, tags, source_kind, score_rerank, first_round AS round_found, first_ord AS ord FROM ranked WHERE best = 1)"""


def pool(spark, sf_dir, *unread: str) -> DataFrame:
    """The pool without what its reader doesn't look at; what is stored would be worked out, read or not."""
    return stored(evidence.upsert(fixtures.cards(spark, sf_dir).drop(*unread)), "pool")


@query("pool_upsert", f"WITH {CARDS} SELECT fingerprint, id, score_rerank, round_found, ord FROM pool")
def pool_upsert(spark, sf_dir):
    # columns are named before: an aggregate of whole cards keeps all of them
    return evidence.upsert(fixtures.cards(spark, sf_dir).select("fingerprint", "id", "score_rerank", "round_found", "ord"))


EVICTION = """
kinds AS (SELECT source_kind, 1.0::DOUBLE / (count(*) + 1) AS kind_rarity FROM pool GROUP BY ALL),
each AS (SELECT fingerprint, unnest(tags) AS tag FROM pool),
tag_counts AS (SELECT tag, 1.0::DOUBLE / (count(*) + 1) AS rarity FROM each GROUP BY ALL),
rarest AS (SELECT fingerprint, max(rarity) AS tag_rarity FROM each JOIN tag_counts USING (tag) GROUP BY ALL),
scored AS (SELECT pool.*, round(score_rerank + 0.2::DOUBLE * greatest(0, 2 - (2 - round_found)) + 0.2::DOUBLE * kind_rarity + 0.15::DOUBLE * coalesce(tag_rarity, 0), 9) AS evict_score
           FROM pool JOIN kinds USING (source_kind) LEFT JOIN rarest USING (fingerprint))"""


@query("eviction_scores", f"WITH {CARDS}, {EVICTION} SELECT fingerprint, evict_score FROM scored")
def eviction_scores(spark, sf_dir):
    return evidence.eviction_scores(pool(spark, sf_dir, "entities", "chunk_text"), 2).select("fingerprint", "evict_score")


@query("evicted_pool", f"WITH {CARDS}, {EVICTION} SELECT fingerprint FROM scored ORDER BY evict_score DESC, ord DESC LIMIT 200")
def evicted_pool(spark, sf_dir):
    return evidence.evict(pool(spark, sf_dir, "entities", "chunk_text"), 2).select("fingerprint")


@query(
    "working_set",
    f"""WITH {CARDS}, {EVICTION},
small AS (SELECT * FROM scored ORDER BY evict_score DESC, ord DESC LIMIT 200),
placed AS (SELECT *, row_number() OVER (ORDER BY score_rerank DESC, ord) AS rn, string_split(path, '/')[2] || '/src' AS module FROM small),
fresh AS (SELECT *, rn = min(rn) OVER (PARTITION BY module) AS new_module FROM placed),
new_tags AS (SELECT DISTINCT min(rn) AS rn FROM (SELECT rn, unnest(tags) AS tag FROM placed) GROUP BY tag),
kept AS (SELECT fresh.*, row_number() OVER (ORDER BY rn) AS rank FROM fresh WHERE rn <= 10 OR new_module OR rn IN (SELECT rn FROM new_tags))
SELECT rank::INTEGER AS rank, id, module, score_rerank FROM kept WHERE rank <= 20""",
)
def working_set(spark, sf_dir):
    return evidence.working_set(stored(evidence.evict(pool(spark, sf_dir, "entities", "chunk_text"), 2), "small")).select("rank", "id", "module", "score_rerank")


@query(
    "quality_gate",
    f"""WITH {CARDS}, seen AS (SELECT count(*) AS n, count_if(source_kind = 'code') AS code, len(list_distinct(flatten(list(tags)))) AS tags, bool_or(list_contains(tags, 'callsite') OR list_contains(tags, 'invocation')) AS call FROM pool)
SELECT false AS passed, CASE WHEN n = 0 THEN 'no_evidence' WHEN code < 2 THEN 'insufficient_code_evidence: ' || code || '/2' WHEN tags < 2 THEN 'insufficient_tag_diversity: ' || tags || '/2' WHEN NOT call THEN 'missing_call_edge_evidence' ELSE 'missing_named_entity' END AS reason FROM seen""",
)
def quality_gate(spark, sf_dir):
    return evidence.quality_gate(pool(spark, sf_dir))


NEEDS = {"timeouts": ["config key", "default value"], "calls": ["call edge"], "words": ["thing", "und", "nowhere at all"], "nothing": []}


@query(
    "accept_coverage",
    r"""WITH t AS (SELECT coalesce(text, '') AS c FROM documents),
met AS (SELECT bool_or(regexp_matches(c, '(?i)\.timeout|\.ttl|config\[|@Value|Configuration\[')) AS a, bool_or(regexp_matches(c, '(?i)default\s*[:=]|fallback|\?\?|\|\|')) AS b,
  bool_or(regexp_matches(c, '(?i)\w+\.\w+\(|await\s+\w+|\.Invoke\(|\.Execute\(')) AS d, bool_or(regexp_matches(c, '(?i)thing')) AS e, bool_or(regexp_matches(c, '(?i)und')) AS f, bool_or(regexp_matches(c, '(?i)nowhere at all')) AS g FROM t),
n AS (SELECT * FROM (VALUES ('timeouts', 2), ('calls', 1), ('words', 3), ('nothing', 0)) AS v(need, n_items)),
found AS (SELECT need, n_items, CASE need WHEN 'timeouts' THEN a::INTEGER + b::INTEGER WHEN 'calls' THEN d::INTEGER WHEN 'words' THEN e::INTEGER + f::INTEGER + g::INTEGER ELSE 0 END AS n_covered FROM n, met)
SELECT need, n_items::BIGINT AS n_items, n_covered::BIGINT AS n_covered, n_items = 0 OR n_covered / greatest(n_items, 1) >= 0.67 AS satisfied FROM found""",
)
def accept_coverage(spark, sf_dir):
    return evidence.accept_coverage(fixtures.documents(spark, sf_dir), NEEDS, "text")


@query(
    "category_counts",
    "SELECT source, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('src0'), ('src1'), ('src2'), ('none')) AS v(source) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY ALL) USING (source)",
)
def category_counts(spark, sf_dir):
    return retrieval.category_counts(fixtures.documents(spark, sf_dir), ("src0", "src1", "src2", "none"), "source")


def files(spark, sf_dir) -> DataFrame:
    return fixtures.documents(spark, sf_dir).select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("file_path"), F.md5(F.coalesce("text", F.lit(""))).alias("file_hash"), "doc_id")


FILES = "f AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file_path, md5(coalesce(text, '')) AS file_hash, doc_id FROM documents)"


@query(
    "delta",
    f"""WITH {FILES}, old AS (SELECT file_path, CASE WHEN doc_id % 5 = 1 THEN 'x' ELSE file_hash END AS h FROM f WHERE doc_id % 7 <> 0 UNION ALL SELECT 'gone/' || doc_id, file_hash FROM f WHERE doc_id % 9 = 0)
SELECT file_path, CASE WHEN old.h IS NULL THEN 'new' WHEN f.file_hash IS NULL THEN 'deleted' WHEN old.h <> f.file_hash THEN 'changed' ELSE 'same' END AS status FROM f FULL JOIN old USING (file_path)""",
)
def delta(spark, sf_dir):
    own = files(spark, sf_dir)
    known = own.filter("doc_id % 7 <> 0").withColumn("file_hash", F.when(F.col("doc_id") % 5 == 1, "x").otherwise(F.col("file_hash"))).unionByName(own.filter("doc_id % 9 = 0").withColumn("file_path", F.concat(F.lit("gone/"), F.col("doc_id"))))
    return scan.delta(own, known)


@query("aggregate_hash", f"WITH {FILES} SELECT split_part(file_path, '/', 1) AS source, md5(string_agg(file_path || ':' || file_hash || chr(10), '' ORDER BY file_path)) AS hash FROM f GROUP BY ALL")
def aggregate_hash(spark, sf_dir):
    return scan.aggregate_hash(files(spark, sf_dir).withColumn("source", F.split_part("file_path", F.lit("/"), F.lit(1))), by=("source",))


@query(
    "indexable_paths",
    r"""SELECT page_id, CASE WHEN regexp_matches(name, '(?:^|\.)[a-f0-9]{6,20}(?:\.|$)') THEN true ELSE NOT (ext IN ('.html', '.js', '.css')) END AS excluded
FROM (SELECT page_id, split_part(url, '/', -1) AS name, lower(regexp_extract(split_part(url, '/', -1), '^.+(\.[^.]+)$', 1)) AS ext FROM pages)""",
)
def indexable_paths(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "pages").select("page_id", paths.is_excluded("url").alias("excluded"))


GRAPH = """
nodes AS (SELECT 'region.' || r_regionkey AS fqn, r_name AS name, 'class' AS kind, 'geo/regions.cs' AS file_path FROM region
  UNION ALL SELECT 'nation.' || n_nationkey, n_name, 'class', 'geo/region' || n_regionkey || '.cs' FROM nation
  UNION ALL SELECT 'customer.' || c_custkey, c_name, 'method', 'customers/' || c_nationkey || '.cs' FROM customer
  UNION ALL SELECT 'supplier.' || s_suppkey, s_name, CASE WHEN s_suppkey % 10 = 0 THEN 'external' ELSE 'interface' END, 'suppliers/' || s_suppkey % 9 || '.cs' FROM supplier),
edges AS (SELECT DISTINCT * FROM (SELECT 'MEMBER_OF' AS type, 'nation.' || n_nationkey AS source, 'region.' || n_regionkey AS target FROM nation
  UNION ALL SELECT 'MEMBER_OF', 'customer.' || c_custkey, 'nation.' || c_nationkey FROM customer
  UNION ALL SELECT 'INHERITS', 'supplier.' || s_suppkey, 'supplier.' || s_suppkey // 2 FROM supplier WHERE s_suppkey > 1
  UNION ALL SELECT 'IMPLEMENTS', 'supplier.' || s_suppkey, 'nation.' || s_nationkey FROM supplier
  UNION ALL SELECT 'CALLS', 'supplier.' || s_suppkey, 'supplier.' || (s_suppkey * 2 % 97 + 1) FROM supplier
  UNION ALL SELECT 'CALLS', 'supplier.' || s_suppkey, 'supplier.' || (s_suppkey * 3 % 97 + 1) FROM supplier
  UNION ALL SELECT 'USES_TYPE', 'customer.' || o_custkey, 'supplier.' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
both_ways AS (SELECT type || '|' || source || '|' || target AS edge, type, source AS a, target AS b FROM edges UNION ALL SELECT type || '|' || source || '|' || target, type, target, source FROM edges)"""


def graph_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return fixtures.symbols(spark, sf_dir), stored(graph.clean_edges(fixtures.edges(spark, sf_dir)), "graph-edges")


@query("graph_edges", f"WITH {GRAPH} SELECT type, source, target FROM edges")
def graph_edges(spark, sf_dir):
    return graph.clean_edges(fixtures.edges(spark, sf_dir)).select("type", "source", "target")


@query(
    "graph_neighbors",
    f"""WITH {GRAPH}, e AS (SELECT * FROM both_ways WHERE type IN ('INHERITS', 'IMPLEMENTS', 'MEMBER_OF')),
p1 AS (SELECT b AS node, [edge] AS path FROM e WHERE a = 'supplier.3'),
p2 AS (SELECT b AS node, list_append(path, edge) AS path FROM p1 JOIN e ON a = node WHERE NOT list_contains(path, edge)),
p3 AS (SELECT b AS node, list_append(path, edge) AS path FROM p2 JOIN e ON a = node WHERE NOT list_contains(path, edge)),
found AS (SELECT node AS fqn, min(hops) AS hops FROM (SELECT node, 1 AS hops FROM p1 UNION ALL SELECT node, 2 FROM p2 UNION ALL SELECT node, 3 FROM p3) GROUP BY node)
SELECT fqn, name, kind, hops::INTEGER AS hops FROM found JOIN nodes USING (fqn) WHERE kind <> 'external'""",
)
def graph_neighbors(spark, sf_dir):
    nodes, e = graph_tables(spark, sf_dir)
    return graph.neighbors(nodes, e, graph.seed(nodes, "supplier.3"), 3, "both", ["inherits", "implements", "member_of"], limit=None).drop("project")


@query(
    "graph_hierarchy",
    f"""WITH RECURSIVE {GRAPH.strip().replace(chr(10), ' ')},
up AS (SELECT target AS fqn, 1 AS hops FROM edges WHERE type = 'INHERITS' AND source = 'supplier.5' UNION SELECT target, hops + 1 FROM up JOIN edges ON source = fqn AND type = 'INHERITS' WHERE hops < 5),
down AS (SELECT source AS fqn, 1 AS hops FROM edges WHERE type = 'INHERITS' AND target = 'supplier.5' UNION SELECT source, hops + 1 FROM down JOIN edges ON target = fqn AND type = 'INHERITS' WHERE hops < 5)
SELECT 'parent' AS role, fqn, min(hops)::INTEGER AS hops FROM up GROUP BY ALL UNION ALL SELECT 'child', fqn, min(hops)::INTEGER FROM down GROUP BY ALL
UNION ALL SELECT 'interface', target, 1 FROM edges WHERE type = 'IMPLEMENTS' AND source = 'supplier.5'""",
)
def graph_hierarchy(spark, sf_dir):
    return graph.hierarchy(spark, graph_tables(spark, sf_dir)[1], "supplier.5")


@query(
    "graph_call_reach",
    f"""WITH RECURSIVE {GRAPH.strip().replace(chr(10), ' ')},
r AS (SELECT 'supplier.1' AS fqn, 0 AS hops UNION SELECT target, hops + 1 FROM r JOIN edges ON source = fqn AND type = 'CALLS' WHERE hops < 5)
SELECT fqn, min(hops)::INTEGER AS hops FROM r GROUP BY fqn""",
)
def graph_call_reach(spark, sf_dir):
    return graph.reachable(spark, graph_tables(spark, sf_dir)[1].filter("type = 'CALLS'"), ["supplier.1"], 5)


@query(
    "graph_call_chain",
    f"""WITH RECURSIVE {GRAPH.strip().replace(chr(10), ' ')},
calls AS (SELECT source, target FROM edges WHERE type = 'CALLS'),
r AS (SELECT 'supplier.1' AS fqn, 0 AS hops UNION SELECT target, hops + 1 FROM r JOIN calls ON source = fqn WHERE hops < 8),
near AS (SELECT fqn, min(hops) AS hops FROM r GROUP BY fqn),
prior AS (SELECT c.target AS fqn, min(c.source) AS prior FROM calls c JOIN near t ON t.fqn = c.target JOIN near s ON s.fqn = c.source AND s.hops = t.hops - 1 GROUP BY c.target),
chain AS (SELECT fqn, hops FROM near WHERE fqn = 'supplier.28' UNION ALL SELECT prior, hops - 1 FROM chain JOIN prior USING (fqn) WHERE hops > 0)
SELECT hops::INTEGER AS pos, fqn FROM chain""",
)
def graph_call_chain(spark, sf_dir):
    chain = graph.call_chain(spark, graph_tables(spark, sf_dir)[1], "supplier.1", "supplier.28", 8)
    return spark.createDataFrame(list(enumerate(chain)), "pos int, fqn string")


@query(
    "graph_file_dependencies",
    f"""WITH {GRAPH}, pairs AS (SELECT DISTINCT o.file_path, type || ':' || b AS link FROM both_ways JOIN nodes n ON n.fqn = a JOIN nodes o ON o.fqn = b WHERE n.file_path = 'geo/region1.cs' AND o.file_path <> 'geo/region1.cs')
SELECT file_path, count(*)::BIGINT AS n, string_agg(link, ',' ORDER BY link) AS links FROM pairs GROUP BY ALL""",
)
def graph_file_dependencies(spark, sf_dir):
    nodes, e = graph_tables(spark, sf_dir)
    return graph.file_dependencies(nodes, e, "geo/region1.cs", limit=None)


@query(
    "graph_stats",
    f"""WITH {GRAPH} SELECT 'node' AS what, 'Symbol' AS name, count(*)::BIGINT AS n FROM nodes UNION ALL SELECT 'node', 'File', count(DISTINCT file_path) FROM nodes
UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'project', 'shop', count(*) FROM nodes""",
)
def graph_stats(spark, sf_dir):
    nodes, e = graph_tables(spark, sf_dir)
    return graph.stats(nodes, nodes.select("file_path").distinct(), e)


@query(
    "graph_expand",
    f"""WITH {GRAPH}, start AS (SELECT fqn FROM nodes WHERE name IN ('Customer#000000007', 'FRANCE') OR fqn IN ('nation.3', 'supplier.7')),
files AS (SELECT file_path AS path, count(*)::BIGINT AS hits FROM both_ways JOIN start ON a = start.fqn JOIN nodes ON nodes.fqn = b WHERE kind <> 'external' AND file_path <> 'customers/1.cs' GROUP BY ALL ORDER BY hits DESC, path LIMIT 5)
SELECT path, chunk_index, hits FROM files, (VALUES (0), (1)) AS v(chunk_index) ORDER BY hits DESC, path, chunk_index LIMIT 5""",
)
def graph_expand(spark, sf_dir):
    nodes, e = graph_tables(spark, sf_dir)
    chunks = nodes.select(F.col("file_path").alias("path")).distinct().withColumn("chunk_index", F.explode(F.array(*map(F.lit, range(3)))))
    names = spark.createDataFrame([(x,) for x in ("Customer#000000007", "FRANCE", "nation.3", "supplier.7")], "symbol string")
    seen = spark.createDataFrame([("customers/1.cs",)], "path string")
    return graph.expand(names, nodes, e, chunks, seen).select("path", "chunk_index", "hits")


TREE = """
place AS (SELECT n_nationkey AS n, replace(r_name, ' ', '_') AS r, replace(r_name, ' ', '_') || '/' || replace(n_name, ' ', '_') AS loc FROM nation JOIN region ON n_regionkey = r_regionkey),
files AS (SELECT loc || '/' || c_mktsegment || '/' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.java' WHEN 1 THEN '.cs' ELSE '.md' END AS file_path, md5(c_acctbal::DECIMAL(12, 2)::VARCHAR) AS file_hash FROM customer JOIN place ON c_nationkey = n
  UNION ALL SELECT p, md5(p) FROM (SELECT DISTINCT r || '/All.sln' AS p FROM place UNION ALL SELECT loc || '/One.sln' FROM place WHERE n % 2 = 0 UNION ALL SELECT loc || '/pom.xml' FROM place WHERE n % 3 = 0
    UNION ALL SELECT loc || '/build.gradle' FROM place WHERE n % 6 = 0 UNION ALL SELECT DISTINCT loc || '/BUILDING/package.json' FROM customer JOIN place ON c_nationkey = n WHERE c_mktsegment = 'BUILDING')),
named AS (SELECT *, regexp_extract(file_path, '^(.*/)?[^/]*$', 1) AS folder, split_part(file_path, '/', -1) AS name FROM files),
roots AS (SELECT folder, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS project_type FROM (SELECT folder, CASE WHEN name LIKE '%.sln' THEN 'dotnet' WHEN name = 'pom.xml' THEN 'java-maven' WHEN name = 'build.gradle' THEN 'java-gradle' WHEN name = 'package.json' THEN 'node' END AS kind FROM named) WHERE kind IS NOT NULL GROUP BY folder),
sol AS (SELECT file_path AS solution, folder, CASE WHEN name LIKE '%.sln' THEN '.cs' ELSE '.java' END AS ext FROM named WHERE name LIKE '%.sln' OR name IN ('pom.xml', 'build.gradle')),
near AS (SELECT file_path, file_hash, arg_min(solution, (-length(sol.folder), solution)) AS solution FROM named JOIN sol ON starts_with(file_path, sol.folder) AND ends_with(name, ext) GROUP BY ALL)"""


@query(
    "file_homes",
    f"""WITH {TREE}, home AS (SELECT file_path, arg_max(r.folder, length(r.folder)) AS project_root, arg_max(project_type, length(r.folder)) AS project_type FROM named JOIN roots r ON starts_with(file_path, r.folder) GROUP BY ALL)
SELECT file_path, coalesce(project_root, '') AS project_root, coalesce(project_type, 'unknown') AS project_type, solution FROM files LEFT JOIN home USING (file_path) LEFT JOIN near USING (file_path)""",
)
def file_homes(spark, sf_dir):
    """Each file's nearest project and solution."""
    files = stored(fixtures.tree(spark, sf_dir), "tree")
    return projects.nearest_project(files).join(projects.nearest_solution(files).select("file_path", "solution"), "file_path", "left")


@query(
    "solution_hashes",
    f"""WITH {TREE}, part AS (SELECT solution, md5(file_path || ':' || file_hash) AS h FROM near)
SELECT solution, count(*)::BIGINT AS files, md5('v2:' || count(*) || ':' || sum(('0x' || substr(h, 1, 14))::BIGINT)::HUGEINT || ':' || sum(('0x' || substr(h, 15, 14))::BIGINT)::HUGEINT) AS solution_hash FROM part GROUP BY solution""",
)
def solution_hashes(spark, sf_dir):
    return projects.solution_hashes(projects.nearest_solution(fixtures.tree(spark, sf_dir)), "v2")


@query(
    "graph_state",
    """WITH part AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS project, 'f' || s_suppkey % 20 AS file_path, s_name AS name, s_nationkey AS nation FROM supplier),
sym AS (SELECT project, 'supplier.' || k AS fqn, name, 'class' AS kind, file_path FROM part WHERE project = 'b' OR (project = 'a' AND k % 20 >= 5 AND k % 2 = 0)),
edge AS (SELECT DISTINCT project, 'CALLS' AS type, 'supplier.' || k AS source, 'nation.' || nation AS target FROM part WHERE project = 'b' OR (project = 'a' AND k % 20 >= 5 AND k % 2 = 0)
  UNION SELECT DISTINCT project, 'USES_TYPE', 'nation.' || nation, 'supplier.' || (k + 3) FROM part WHERE project = 'b' OR (project = 'a' AND k % 20 >= 5 AND k % 2 = 0)),
ends AS (SELECT project, fqn, arg_min(kind, o) AS kind, arg_min(name, o) AS name FROM (SELECT project, target AS fqn, 'external' AS kind, target AS name, 0 AS o FROM edge UNION ALL SELECT project, source, '', '', 1 FROM edge) GROUP BY ALL)
SELECT project, fqn, name, kind, file_path FROM sym UNION ALL SELECT project, fqn, nullif(name, ''), nullif(kind, ''), NULL FROM ends e WHERE NOT EXISTS (SELECT 1 FROM sym s WHERE s.project = e.project AND s.fqn = e.fqn)""",
)
def graph_state(spark, sf_dir):
    """Three projects put, one's files deleted and changed in part, another deleted whole: what is left, with placeholders for ends."""
    c = F.col
    project = F.when(c("s_suppkey") % 3 == 0, "a").when(c("s_suppkey") % 3 == 1, "b").otherwise("c")
    own = fixtures.read(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), project.alias("project"), F.concat(F.lit("f"), (c("s_suppkey") % 20).cast("string")).alias("file_path"), c("s_name").alias("name"), c("s_nationkey").alias("nation"))
    name = lambda kind, k: F.concat(F.lit(f"{kind}."), k.cast("string"))

    def parts(rows):
        files = rows.select("project", "file_path").distinct().withColumn("file_hash", F.md5("file_path"))
        symbols = rows.select("project", "file_path", name("supplier", c("k")).alias("fqn"), "name", F.lit("class").alias("kind"))
        edges = rows.select("project", "file_path", F.lit("calls").alias("type"), name("supplier", c("k")).alias("source"), name("nation", c("nation")).alias("target"))
        more = rows.select("project", "file_path", F.lit("uses_type").alias("type"), name("nation", c("nation")).alias("source"), name("supplier", c("k") + 3).alias("target"))
        return files, symbols, edges.unionByName(more)

    state = GraphState(spark, shared_folder(spark, "graph-state"))
    state.put(*parts(own))
    state.delete_files("a", own.filter("k % 20 < 5").select("file_path").distinct())
    files, symbols, edges = parts(own.filter("project = 'a' AND k % 20 >= 5 AND k % 2 = 0"))
    state.put(parts(own.filter("project = 'a' AND k % 20 >= 5"))[0], symbols, edges)
    state.delete_project("c")
    return state.nodes()


CODE = """
space AS (SELECT n_nationkey AS n, replace(r_name, ' ', '_') || '.' || replace(n_name, ' ', '_') AS ns, replace(n_name, ' ', '_') AS short FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, n, ns, c_mktsegment AS seg, ns || '.' || c_mktsegment || '.' || c_name AS fqn, replace(ns, '.', '/') || '.cs' AS file_path FROM customer JOIN space ON c_nationkey = n),
symbols AS (SELECT fqn FROM cust UNION SELECT ns || '.suppliers.' || s_name FROM supplier JOIN space ON s_nationkey = n UNION SELECT ns || '.suppliers.Common' FROM space UNION SELECT ns || '.' || seg FROM cust),
refs AS (SELECT DISTINCT fqn AS source, file_path, CASE o_orderkey % 7 WHEN 0 THEN seg WHEN 1 THEN b.short || '.' || seg WHEN 2 THEN 'Supplier#' || lpad((o_orderkey % 97 + 1)::VARCHAR, 9, '0') WHEN 3 THEN b.ns || '.' || seg
  WHEN 4 THEN 'List<' || seg || '>[]' WHEN 5 THEN 'System.' || seg ELSE 'Common' END AS target
  FROM orders JOIN cust ON o_custkey = c_custkey JOIN space b ON b.n = (cust.n + 1) % 25),
imports AS (SELECT replace(a.ns, '.', '/') || '.cs' AS file_path, b.ns || '.suppliers' AS target FROM space a JOIN space b ON b.n = (a.n + 1) % 25 WHERE a.n % 2 = 0
  UNION SELECT replace(a.ns, '.', '/') || '.cs', b.ns || '.suppliers.Common' FROM space a JOIN space b ON b.n = (a.n + 2) % 25 WHERE a.n % 3 = 0)"""


@query(
    "resolved_names",
    f"""WITH {CODE},
asked AS (SELECT *, split_part(target, '<', 1) AS name, string_split(source, '.') AS s FROM refs),
known AS (SELECT * FROM asked WHERE name NOT IN ('List') AND NOT starts_with(name, 'System.')),
around AS (SELECT source, file_path, name, unnest(range(1, len(s) + 1)) AS k, s FROM known),
scoped AS (SELECT a.source, a.file_path, a.name, arg_max(fqn, k) AS fqn FROM around a JOIN symbols ON fqn = array_to_string(s[1:k], '.') || '.' || name GROUP BY ALL),
imported AS (SELECT DISTINCT k.file_path, name, fqn, CASE WHEN fqn = i.target THEN 0 ELSE 1 END AS place FROM known k JOIN imports i USING (file_path) JOIN symbols ON fqn = i.target || '.' || name OR (fqn = i.target AND ends_with(i.target, '.' || name))),
first_import AS (SELECT file_path, name, arg_min(fqn, place) AS fqn, min(place) AS place FROM imported GROUP BY ALL),
ends AS (SELECT name, count(*) AS n, min(fqn) AS fqn FROM (SELECT DISTINCT name FROM known) JOIN symbols ON ends_with(fqn, '.' || name) GROUP BY ALL)
SELECT k.source, k.target AS name, coalesce(e.fqn, sc.fqn, i.fqn, CASE WHEN u.n = 1 THEN u.fqn END, k.target) AS target,
  CASE WHEN x.name IS NULL THEN 'external' WHEN e.fqn IS NOT NULL THEN 'exact' WHEN sc.fqn IS NOT NULL THEN 'scope' WHEN i.place = 0 THEN 'import' WHEN i.place = 1 THEN 'namespace' WHEN u.n = 1 THEN 'suffix' WHEN u.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS how
FROM asked k LEFT JOIN (SELECT DISTINCT name FROM known) x USING (name) LEFT JOIN symbols e ON e.fqn = k.name LEFT JOIN scoped sc ON sc.source = k.source AND sc.file_path = k.file_path AND sc.name = k.name
LEFT JOIN first_import i ON i.file_path = k.file_path AND i.name = k.name LEFT JOIN ends u ON u.name = k.name""",
)
def resolved_names(spark, sf_dir):
    """Names in references as the symbols that they mean: by scope, import, or as the only one that ends so."""
    symbols, references, imports = fixtures.code(spark, sf_dir)
    own = references.withColumn("asked", F.col("target"))
    return resolve.resolve(own, symbols, imports).select("source", F.col("asked").alias("name"), "target", "how")


@query(
    "message_routes",
    r"""WITH pub AS (SELECT 'user.' || event_id % 400 AS publisher, event_type || '.' || user_id % 12 || '.' || (props->>'$.k') AS topic FROM events),
con AS (SELECT c_name AS consumer, CASE c_custkey % 8 WHEN 0 THEN kind || '.' || a || '.' || b WHEN 1 THEN kind || '.#' WHEN 2 THEN '*.' || a || '.*' WHEN 3 THEN '#.' || b WHEN 4 THEN kind || '.#.' || b WHEN 5 THEN '*.*.' || b WHEN 6 THEN kind || '.*' ELSE '#.' || a || '.#.*' END AS pattern
  FROM (SELECT c_name, c_custkey, ['click', 'purchase', 'view'][c_custkey % 3 + 1] AS kind, c_custkey % 12 AS a, c_custkey % 50 AS b FROM customer)),
p AS (SELECT pattern, count(DISTINCT consumer)::BIGINT AS consumers, '^' || array_to_string(list_transform(string_split(pattern, '.'), lambda w: CASE w WHEN '#' THEN '(\.[^.]*)*' WHEN '*' THEN '\.[^.]*' ELSE '\.' || w END), '') || '$' AS expression FROM con GROUP BY pattern),
t AS (SELECT topic, count(DISTINCT publisher)::BIGINT AS publishers FROM pub WHERE topic IS NOT NULL GROUP BY topic)
SELECT topic, pattern, publishers, consumers FROM t JOIN p ON regexp_full_match('.' || topic, expression)""",
)
def message_routes(spark, sf_dir):
    """Which bindings each topic reaches, and how many publish and hear it."""
    return messaging.routes(*fixtures.messages(spark, sf_dir)).drop("project")


@query(
    "trace_rollup",
    "SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def trace_rollup(spark, sf_dir):
    return trace.hourly(fixtures.read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(ts) AS began, max(ts) AS ended FROM s GROUP BY ALL""",
)
def session_windows(spark, sf_dir):
    return trace.sessions(fixtures.read(spark, sf_dir, "events"))


@query("line_chunks")
def line_chunks(spark, sf_dir):
    docs = fixtures.documents(spark, sf_dir).select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("file_path"), F.col("text").alias("content"))
    return chunking.token_chunks(docs, 128).select("file_path", "chunk_index", "total_chunks", "content")


@query("html_chunks")
def html_chunks(spark, sf_dir):
    pages = fixtures.read(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file_path"), F.col("html").alias("content"))
    return chunking.symbols(pages).select("file_path", "name", "node_type", "start_line", "end_line")


@query(
    "role_turns",
    "SELECT role, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS conversations, sum(length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM conversations GROUP BY ALL",
)
def role_turns(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.sum(text.token_estimate("text")).alias("tokens"))


@query(
    "cache_misses",
    """WITH h AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS content_hash FROM documents), kept AS (SELECT DISTINCT content_hash FROM h WHERE doc_id % 3 = 0)
SELECT content_hash, min(doc_id) AS doc_id FROM h WHERE content_hash NOT IN (SELECT content_hash FROM kept) GROUP BY ALL""",
)
def cache_misses(spark, sf_dir):
    """Distinct texts that a cache filled from every third document lacks."""
    own = fixtures.documents(spark, sf_dir).select("doc_id", "text", text.content_hash("text").alias("content_hash"))
    cache = EmbeddingCache(spark, shared_folder(spark, "cache"), "hashing-64")
    cache.embed(own.filter("doc_id % 3 = 0").select("text"), "text")
    return cache.misses(own.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))).select("content_hash", "doc_id")


@query(
    "search_records",
    """WITH e AS (SELECT user_id || '-' || (event_id % 40) AS search_id, ts, value, CASE WHEN event_id % 9 = 0 THEN 'end' WHEN event_id % 9 = 1 THEN 'start' WHEN event_id % 9 < 5 THEN 'iteration' ELSE 'llm_call' END AS event FROM events),
f AS (SELECT search_id, min(ts) FILTER (event = 'end') AS first_end FROM e GROUP BY search_id),
own AS (SELECT e.* FROM e JOIN f USING (search_id) WHERE first_end IS NULL OR ts <= first_end)
SELECT search_id, min(ts) AS began, max(ts) AS ended, count_if(event = 'iteration')::BIGINT AS iterations, count_if(event = 'llm_call')::BIGINT AS llm_calls,
  round(coalesce(sum(round(value, 3)) FILTER (event = 'llm_call'), 0), 3) AS latency_ms, bool_or(event = 'end') AS closed FROM own GROUP BY search_id""",
)
def search_records(spark, sf_dir):
    """A record for each search of a trace, which events are read as."""
    k = F.col("event_id") % 9
    event = F.when(k == 0, "end").when(k == 1, "start").when(k < 5, "iteration").otherwise("llm_call")
    own = fixtures.read(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.col("event_id") % 40).alias("search_id"), F.col("ts").alias("timestamp"), event.alias("event"), F.format_string('{"latency_ms": %.3f}', F.round("value", 3)).alias("data"))
    return trace.searches(own).withColumn("latency_ms", F.round("latency_ms", 3))


@query(
    "merged_analyses",
    """WITH o AS (SELECT conv_id::VARCHAR AS search_id, role AS persona, turn % 3 AS priority, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations),
one AS (SELECT search_id, persona, priority, arg_min(w, turn) AS w FROM o GROUP BY ALL),
c AS (SELECT search_id, x, min((priority, persona, i)) AS spot FROM (SELECT *, unnest(range(1, least(len(w), 6) + 1)) AS i, w[i] AS x FROM one) WHERE x <> '' GROUP BY ALL),
g AS (SELECT search_id, x, min((priority, persona, i)) AS spot FROM (SELECT *, unnest(range(1, least(len(w), 12) - 6 + 1)) AS i, w[i + 6] AS x FROM one) WHERE x <> '' GROUP BY ALL)
SELECT search_id, coalesce((SELECT arg_min(w[1], (priority, persona)) FROM one s WHERE s.search_id = b.search_id AND w[1] <> ''), '') AS subject,
  coalesce((SELECT string_agg(x, ' ' ORDER BY spot) FROM c WHERE c.search_id = b.search_id), '') AS covered, coalesce((SELECT string_agg(x, ' ' ORDER BY spot) FROM g WHERE g.search_id = b.search_id), '') AS gaps,
  coalesce((SELECT string_agg('[' || persona || '] ' || w[2], ' | ' ORDER BY priority, persona) FROM one s WHERE s.search_id = b.search_id AND w[2] <> ''), '') AS reasoning
FROM (SELECT DISTINCT search_id FROM one) b""",
)
def merged_analyses(spark, sf_dir):
    """Turns of a conversation read as analysts' outputs and merged."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    own = fixtures.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("search_id"), F.col("role").alias("persona"), (F.col("turn") % 3).alias("priority"), "turn", words.alias("w"))
    own = own.groupBy("search_id", "persona", "priority").agg(F.min_by("w", "turn").alias("w"))
    outputs = own.select("search_id", "persona", "priority", F.get("w", F.lit(0)).alias("subject"), F.array().cast("array<struct<name:string,role:string>>").alias("actors"), F.slice("w", 1, 6).alias("covered"), F.slice("w", 7, 6).alias("gaps"), F.get("w", F.lit(1)).alias("reasoning"))
    return evidence.merge_analyses(outputs).select("search_id", "subject", F.array_join("covered", " ").alias("covered"), F.array_join("gaps", " ").alias("gaps"), "reasoning")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms to cards: keyword top 10 of a query, reranked, with fingerprints, tags and snippets."""
    docs, postings, idf = built(spark, sf_dir, WORD_QUERIES)
    hits = retrieval.keyword_top_k(postings, idf, retrieval.query_terms(spark, WORD_QUERIES[:1]), "doc_id", 10).join(docs, "doc_id")
    best = retrieval.simple_rerank(hits.withColumn("score", F.col("score") / 1_000_000.0), WORD_QUERIES[0][1])
    path = F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt")))
    order = W.orderBy(F.desc("score_rerank"), "doc_id")
    return best.select(F.row_number().over(order).alias("rank"), "doc_id", "score_rerank", text.fingerprint("text", F.col("doc_id").cast("string"), path).alias("fingerprint"), text.snippet("text").alias("snippet"), F.array_join(text.tags("text", path), ",").alias("tags"))

