"""Tokenizer, trigram, similarity and keyword-weight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import corpus as C
from ..sources import items as I
from . import sql
from .common import DOC_QUERY, QUERY, part, query, query_vector, r6, table, vector_literal


def _tokens(source: str, key: str, column: str, name: str) -> None:
    @query(name, f"SELECT {key}, len(t)::BIGINT AS n_tokens, md5({sql.joined('t')}) AS tokens_md5 FROM (SELECT {key}, {sql.tokens(column)} AS t FROM {source})")
    def run(spark, sf_dir):
        rows = table(spark, sf_dir, source).select(key, X.tokenize(F.col(column)).alias("t"))
        return rows.select(key, F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_tokens("documents", "doc_id", "text", "tokenize_documents")
_tokens("pages", "page_id", "html", "tokenize_pages")



@query("tokenize_glue", f"SELECT page_id, t AS token, count(*)::BIGINT AS n FROM (SELECT page_id, unnest({sql.tokens('url')}) AS t FROM pages) WHERE contains(t, '.') OR contains(t, '''') GROUP BY page_id, t")
def tokenize_glue(spark, sf_dir):
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(X.tokenize(F.col("url"))).alias("token"))
    return each.where(F.col("token").rlike("[.']")).groupBy("page_id", "token").agg(F.count(F.lit(1)).alias("n"))


CAMEL = "'get' || p_type || 'HTTPResponse_' || p_name"


@query("tokenize_case_split", f"SELECT p_partkey, {sql.joined(sql.tokens(CAMEL))} AS tokens FROM part")
def tokenize_case_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.tokenize(F.expr(CAMEL)), " ").alias("tokens"))


@query("char_trigrams", f"SELECT p_partkey, len(t)::BIGINT AS n, array_to_string(t, '|') AS trigrams FROM (SELECT p_partkey, {sql.trigrams('lower(p_name)')} AS t FROM part)")
def char_trigrams(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", X.char_trigrams(F.col("p_name")).alias("t"))
    return rows.select("p_partkey", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("trigrams"))


@query("canonical_text", f"SELECT page_id, {sql.joined(sql.tokens('html'))} AS canonical FROM pages")
def canonical_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_text(F.col("html")).alias("canonical"))


@query("canonical_trigrams", f"SELECT doc_id, len(g)::BIGINT AS n, md5(array_to_string(list_sort(g), '|')) AS grams_md5 FROM (SELECT doc_id, {sql.trigram_set('c')} AS g FROM (SELECT doc_id, {sql.joined(sql.tokens('text'))} AS c FROM documents))")
def canonical_trigrams(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.canonical_trigrams(F.col("text")).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("grams_md5"))


PAIR = f"(SELECT p_partkey, {sql.trigram_set('a')} AS a, {sql.trigram_set('b')} AS b FROM (SELECT p_partkey, {sql.joined(sql.tokens('p_name'))} AS a, {sql.joined(sql.tokens('p_type'))} AS b FROM part))"


@query("trigram_dice_pairs", f"SELECT p_partkey, round({sql.dice('a', 'b')}, 6) AS dice FROM {PAIR}")
def trigram_dice_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(S.dice(F.col("p_name"), F.col("p_type"))).alias("dice"))


@query("trigram_dice_sets", f"SELECT p_partkey, len(list_intersect(a, b))::BIGINT AS n_both, len(a)::BIGINT AS n_a, len(b)::BIGINT AS n_b, round({sql.dice('a', 'b')}, 6) AS dice FROM {PAIR}")
def trigram_dice_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", X.canonical_trigrams(F.col("p_name")).alias("a"), X.canonical_trigrams(F.col("p_type")).alias("b"))
    size = lambda c: F.size(c).cast("long")
    return rows.select("p_partkey", size(F.array_intersect("a", "b")).alias("n_both"), size("a").alias("n_a"), size("b").alias("n_b"), r6(S.dice_sets(F.col("a"), F.col("b"))).alias("dice"))


@query("trigram_score", f"WITH {sql.docs('part')}, q AS (SELECT {sql.trigram_set('c')} AS g FROM (SELECT {sql.joined(sql.tokens(sql.quoted(QUERY)))} AS c)) SELECT id, round(5 * {sql.dice('g', 'pt')} + {sql.dice('g', 'bt')}, 6) AS trigram FROM docs CROSS JOIN q")
def trigram_score(spark, sf_dir):
    grams = X.evaluate(spark, QUERY, X.canonical_trigrams)[0]
    return part(spark, sf_dir).select("id", r6(S.trigram_score(F.lit(grams), F.col("primary_tri"), F.col("body_tri"))).alias("trigram"))


@query("trigram_overlap_join", f"WITH {sql.docs('part')}, q AS (SELECT unnest({sql.trigram_set('c')}) AS tri FROM (SELECT {sql.joined(sql.tokens(sql.quoted(QUERY)))} AS c)), each AS (SELECT id, unnest(bt) AS tri FROM docs) SELECT id, count(*)::BIGINT AS n_both FROM each JOIN q USING (tri) GROUP BY id")
def trigram_overlap_join(spark, sf_dir):
    wanted = spark.range(1).select(F.explode(X.canonical_trigrams(F.lit(QUERY))).alias("tri"))
    each = part(spark, sf_dir).select("id", F.explode("body_tri").alias("tri"))
    return each.join(wanted, "tri").groupBy("id").agg(F.count(F.lit(1)).alias("n_both"))


@query("bm25_constants", "SELECT 1.2::DOUBLE AS k1, 0.75::DOUBLE AS b, 5::DOUBLE AS primary_weight, 1::DOUBLE AS body_weight")
def bm25_constants(spark, sf_dir):
    return spark.range(1).select(F.lit(S.K1).alias("k1"), F.lit(S.B).alias("b"), F.lit(S.PRIMARY_WEIGHT).alias("primary_weight"), F.lit(S.BODY_WEIGHT).alias("body_weight"))


def _posts(spark, sf_dir, source=I.document_items):
    return C.postings(C.first_by_id(source(spark, sf_dir)))


DOCS_SQL = f"{sql.docs('documents')}, {sql.POSTS}"


@query("bm25_df", f"WITH {sql.docs('documents')}, {sql.bm25(DOC_QUERY)} SELECT term, df::BIGINT AS df FROM df")
def bm25_df(spark, sf_dir):
    terms = spark.range(1).select(F.explode(F.array_distinct(X.tokenize(F.lit(DOC_QUERY)))).alias("term"))  # a few literal terms
    return _posts(spark, sf_dir).join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("bm25_idf", f"WITH {DOCS_SQL}, df AS (SELECT term, count(*)::DOUBLE AS df FROM posts GROUP BY term) SELECT term, df::BIGINT AS df, round({sql.IDF}, 6) AS idf FROM df CROSS JOIN stats")
def bm25_idf(spark, sf_dir):
    rows = I.document_items(spark, sf_dir)
    n = float(rows.select("id").distinct().count())
    df = C.document_frequencies(C.first_by_id(rows))
    return df.select("term", "df", r6(S.idf(F.lit(n), F.col("df").cast("double"))).alias("idf"))


@query("bm25_length_norm", f"WITH {sql.docs('documents')}, stats AS (SELECT avg(doc_len)::DOUBLE AS avgdl FROM docs) SELECT id, round({sql.NORM}, 6) AS norm FROM docs CROSS JOIN stats")
def bm25_length_norm(spark, sf_dir):
    size = F.size(X.tokenize(F.col("primary_text"))) + F.size(X.tokenize(F.col("text")))
    rows = I.document_items(spark, sf_dir).select("id", size.alias("doc_len"))
    average = rows.agg(F.avg("doc_len")).first()[0] or 1.0
    return rows.select("id", r6(S.length_norm(F.col("doc_len"), F.lit(average))).alias("norm"))


VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("e")), vector_literal(query_vector(spark, sf_dir))


@query("cosine_scan", "SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding)::BIGINT AS dimension FROM embeddings")
def cosine_scan(spark, sf_dir):
    rows, _ = _vectors(spark, sf_dir)
    return rows.select(F.col("vec_id").cast("string").alias("id"), F.size("e").cast("long").alias("dimension"))


@query("cosine_scalar", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR}), 4) AS cosine FROM embeddings")
def cosine_scalar(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir)
    return rows.select("vec_id", F.round(S.cosine(q, F.col("e")), 4).alias("cosine"))


@query("cosine_matvec", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {VECTOR}), 4) AS score FROM embeddings")
def cosine_matvec(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir)
    return rows.select("vec_id", F.round(S.matvec(F.col("e"), q, len(query_vector(spark, sf_dir))).cast("double"), 4).alias("score"))


@query("vector_dot", f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {VECTOR}), 4) AS dot FROM embeddings")
def vector_dot(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir)
    return rows.select("vec_id", F.round(S.dot(F.col("e"), q).cast("double"), 4).alias("dot"))


@query("vector_norm", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS square_norm FROM embeddings")
def vector_norm(spark, sf_dir):
    rows, _ = _vectors(spark, sf_dir)
    return rows.select("vec_id", F.round(S.square_norm(F.col("e")).cast("double"), 4).alias("square_norm"))


@query("cosine_topk", f"SELECT vec_id, cosine FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR}), 4) AS cosine FROM embeddings) WHERE cosine > 0 ORDER BY cosine DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    rows, q = _vectors(spark, sf_dir)
    scored = rows.select("vec_id", F.round(S.cosine(q, F.col("e")), 4).alias("cosine")).where("cosine > 0")
    return scored.orderBy(F.col("cosine").desc(), "vec_id").limit(20)


@query("query_terms", f"SELECT item_id, unnest(list_distinct({sql.tokens('text')})) AS term FROM benchmark")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("term"))
