"""Corpus, change-log and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..session import shared_dir
from ..sources import items as I
from ..streaming.changelog import StreamingCorpus, replay
from . import sql
from .common import QUERY, part, query, r6, table


@query("corpus_scan", f"SELECT pos, id, primary_text, text, grp FROM ({sql.ITEMS['conversations']})")
def corpus_scan(spark, sf_dir):
    return I.conversation_items(spark, sf_dir).select("pos", "id", "primary_text", "text", F.col("group").alias("grp"))


@query("corpus_defaults", "SELECT CAST(page_id AS VARCHAR) AS id, CAST(page_id AS VARCHAR) AS primary_text, html AS summary FROM pages")
def corpus_defaults(spark, sf_dir):
    rows = I.items(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"), F.col("page_id"))
    return rows.select("id", "primary_text", "summary")


@query("corpus_build", f"WITH {sql.docs('documents')} SELECT id, doc_len::BIGINT AS doc_len, len(list_distinct(list_concat(p, b)))::BIGINT AS n_terms, len(pt)::BIGINT AS n_primary, len(bt)::BIGINT AS n_body FROM docs")
def corpus_build(spark, sf_dir):
    size = lambda c: F.size(c).cast("long")
    return C.build_corpus(I.document_items(spark, sf_dir)).select("id", F.col("doc_len").cast("long").alias("doc_len"), size(F.map_keys("wtf")).alias("n_terms"), size("primary_tri").alias("n_primary"), size("body_tri").alias("n_body"))


@query("ranked_document", f"WITH {sql.docs('part')}, {sql.POSTS} SELECT id, string_agg(term || '=' || tf::BIGINT, ' ' ORDER BY term) AS weighted FROM posts JOIN docs USING (pos) GROUP BY id")
def ranked_document(spark, sf_dir):
    entries = F.transform(F.array_sort(F.map_entries("wtf")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string")))
    return part(spark, sf_dir).select("id", F.array_join(entries, " ").alias("weighted"))


@query("weighted_tf", f"WITH {sql.docs('pages')}, {sql.POSTS} SELECT id, term, tf FROM posts JOIN docs USING (pos)")
def weighted_tf(spark, sf_dir):
    return C.postings(C.first_by_id(I.page_items(spark, sf_dir))).select("id", "term", "tf")


@query("document_length", f"WITH {sql.docs('conversations')} SELECT id, doc_len::BIGINT AS doc_len FROM docs")
def document_length(spark, sf_dir):
    return C.build_corpus(I.conversation_items(spark, sf_dir)).select("id", F.col("doc_len").cast("long").alias("doc_len"))


@query("term_set", f"WITH {sql.docs('conversations')} SELECT DISTINCT id, unnest(list_concat(p, b)) AS term FROM docs")
def term_set(spark, sf_dir):
    return C.build_corpus(I.conversation_items(spark, sf_dir)).select("id", F.explode(F.map_keys("wtf")).alias("term"))


@query("corpus_stats", f"WITH {sql.docs('documents')} SELECT count(*)::BIGINT AS n, round(avg(doc_len), 6) AS avgdl FROM docs")
def corpus_stats(spark, sf_dir):
    return C.corpus_stats(C.build_corpus(I.document_items(spark, sf_dir))).select("n", r6(F.col("avgdl")).alias("avgdl"))


@query("corpus_count", "SELECT count(*)::BIGINT AS n, count(*) = 0 AS is_empty FROM part")
def corpus_count(spark, sf_dir):
    return part(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).withColumn("is_empty", F.col("n") == 0)


@query("embedding_completeness", "SELECT bool_and(v.embedding IS NOT NULL) AS complete, count(v.embedding)::BIGINT AS n_embedded FROM part LEFT JOIN embeddings v ON v.vec_id = p_partkey")
def embedding_completeness(spark, sf_dir):
    rows = I.vector_items(spark, sf_dir)
    return rows.agg(F.bool_and(F.col("embedding").isNotNull()).alias("complete"), F.count("embedding").alias("n_embedded"))


def _lookup(name: str, column: str, **out: tuple) -> None:
    """``out``: for each column of the result what it is of the looked-up one, in Spark and in SQL."""

    @query(name, f"SELECT CAST(e.user_id AS VARCHAR) AS id, {', '.join(f'{x[1]} AS {c}' for c, x in out.items())} FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN (SELECT * FROM part LEFT JOIN embeddings ON vec_id = p_partkey) p ON p.p_partkey = e.user_id")
    def run(spark, sf_dir):
        ids = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id")).distinct()
        found = C.lookup(C.precompute(I.vector_items(spark, sf_dir)), ids, column)
        return found.select("id", *[x[0](F.col(column)).alias(c) for c, x in out.items()])


_lookup("lookup_block", "text", block=(lambda c: c, "p_brand || ' ' || p_type"))
_lookup("lookup_summary", "summary", summary=(lambda c: c, "p_brand || ' ' || p_type"))
_lookup(
    "lookup_embedding", "embedding", n_components=(lambda c: F.when(c.isNotNull(), F.size(c).cast("long")), "len(embedding)::BIGINT"), first_component=(lambda c: F.round(c[0].cast("double"), 6), "round(embedding[1]::DOUBLE, 6)"),
    by_place=(lambda c: F.round(F.aggregate(F.transform(c, lambda x, k: x.cast("double") * (k + 1)), F.lit(0.0), lambda a, x: a + x), 5), "round(list_sum(list_transform(embedding, lambda x, k: x::DOUBLE * k)), 5)"),
)


@query("dedupe_first_wins", "SELECT CAST(user_id AS VARCHAR) AS id, min(event_id)::BIGINT AS pos, arg_min(event_type, event_id) AS text FROM events GROUP BY user_id")
def dedupe_first_wins(spark, sf_dir):
    rows = I.items(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_type"), F.col("event_id"))
    return C.first_by_id(rows).select("id", "pos", "text")


def _halves(spark, sf_dir):
    """Parts of even keys as the live corpus; all parts as what arrives."""
    rows = I.part_items(spark, sf_dir)
    return C.build_corpus(rows.where("pos % 2 = 0")), rows


@query("incremental_add", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey % 2 = 1 AS added FROM part")
def incremental_add(spark, sf_dir):
    live, arriving = _halves(spark, sf_dir)
    both, added = C.add_items(live, arriving)
    return both.select("id").join(added.select("id", F.lit(True).alias("added")), "id", "left").select("id", F.coalesce("added", F.lit(False)).alias("added"))


@query("remove_ids", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey NOT IN (SELECT DISTINCT user_id FROM events)")
def remove_ids(spark, sf_dir):
    return C.remove_ids(part(spark, sf_dir), table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"))).select("id")


@query("remove_group", "SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_brand <> 'Brand#2' OR p_brand IS NULL")
def remove_group(spark, sf_dir):
    return C.remove_group(part(spark, sf_dir), "Brand#2").select("id")


@query("guarded_embedding_update", "SELECT CAST(p_partkey AS VARCHAR) AS id, vec_id IS NOT NULL AND p_partkey % 3 <> 0 AS written FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def guarded_embedding_update(spark, sf_dir):
    """Embeddings arrive for rows whose text may have changed meanwhile (keys divisible by 3): those stay without."""
    live = part(spark, sf_dir)
    text = F.when(F.col("pos") % 3 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    found = I.vector_items(spark, sf_dir).where("embedding is not null").select("id", "embedding", text.alias("expected_text"))
    return C.set_embeddings(live, found).select("id", F.col("embedding").isNotNull().alias("written"))


LOG = """log AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'remove_id' WHEN 'signup' THEN CASE WHEN event_id % 50 = 0 THEN 'remove_group' ELSE 'add' END ELSE 'add' END AS op,
  CAST(user_id AS VARCHAR) AS id, event_type AS text, CAST(user_id % 7 AS VARCHAR) AS grp FROM events),
gone AS (SELECT id, seq FROM log WHERE op = 'remove_id' UNION ALL SELECT m.id, g.seq FROM log g JOIN (SELECT DISTINCT id, grp FROM log WHERE op = 'add') m USING (grp) WHERE g.op = 'remove_group'),
last AS (SELECT id, max(seq) AS seq FROM gone GROUP BY id),
live AS (SELECT l.id, min(l.seq)::BIGINT AS seq, arg_min(l.text, l.seq) AS text FROM log l LEFT JOIN last USING (id) WHERE l.op = 'add' AND l.seq > coalesce(last.seq, -1) GROUP BY l.id)"""


def _log(spark, sf_dir) -> DataFrame:
    """Events as changes: errors remove their user, every fiftieth sign-up a group of users, all others add."""
    rows = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "remove_id").when((F.col("event_type") == "signup") & (F.col("event_id") % 50 == 0), "remove_group").otherwise("add")
    user = F.col("user_id").cast("string")
    return rows.select(F.col("event_id").alias("seq"), op.alias("op"), user.alias("id"), user.alias("primary_text"), F.col("event_type").alias("text"), F.col("event_type").alias("summary"), (F.col("user_id") % 7).cast("string").alias("group"))


@query("changelog_replay", f"WITH {LOG} SELECT id, seq, text FROM live")
def changelog_replay(spark, sf_dir):
    return replay(_log(spark, sf_dir)).select("id", "seq", "text")


def _stream(spark, embedder=None) -> StreamingCorpus:
    return StreamingCorpus(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", embedder)


def _as_adds(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("pos").alias("seq"), F.lit("add").alias("op"), "id", "primary_text", "text", "summary", "group")


@query("stream_bootstrap", f"WITH {sql.docs('part')} SELECT pos, id, doc_len::BIGINT AS doc_len FROM docs")
def stream_bootstrap(spark, sf_dir):
    corpus = _stream(spark)
    corpus.apply(_as_adds(I.part_items(spark, sf_dir)), 0)
    return corpus.snapshot().select("pos", "id", F.col("doc_len").cast("long").alias("doc_len"))


@query("stream_evict", f"WITH {LOG} SELECT id, seq AS pos, text FROM live")
def stream_evict(spark, sf_dir):
    """The change log in three batches by sequence number, with groups as they are on the live rows."""
    corpus, log = _stream(spark), _log(spark, sf_dir)
    third = (log.agg(F.max("seq")).first()[0] or 0) // 3 + 1
    for batch in range(3):
        corpus.apply(log.where((F.col("seq") >= batch * third) & (F.col("seq") < (batch + 1) * third)), batch)
    return corpus.snapshot().select("id", "pos", "text")


class LengthEmbedder:
    """A stand-in for a model: a text's length, its number of spaces, and 1."""

    dimension = 3

    def embed(self, texts):
        return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


@query("stream_add_embed", "SELECT CAST(p_partkey AS VARCHAR) AS id, length(t)::BIGINT AS first, (length(t) - length(replace(t, ' ', '')))::BIGINT AS second, 1::BIGINT AS third FROM (SELECT p_partkey, p_brand || ' ' || p_type AS t FROM part)")
def stream_add_embed(spark, sf_dir):
    corpus = _stream(spark, LengthEmbedder())
    corpus.apply(_as_adds(I.part_items(spark, sf_dir)), 0)
    return corpus.snapshot().select("id", *[F.col("embedding")[k].cast("long").alias(c) for k, c in enumerate(("first", "second", "third"))])


@query("stream_snapshot_search", f"WITH {sql.scored('part', QUERY)} SELECT id, round(score, 6) AS score FROM scored WHERE score IS NOT NULL ORDER BY score DESC, pos LIMIT 20")
def stream_snapshot_search(spark, sf_dir):
    """A search of the version before all economy parts leave."""
    corpus, rows = _stream(spark), I.part_items(spark, sf_dir)
    corpus.apply(_as_adds(rows), 0)
    before = corpus.version()
    leaving = rows.where(F.contains("text", F.lit("ECONOMY"))).select((F.col("pos") + (1 << 40)).alias("seq"), F.lit("remove_id").alias("op"), "id", "primary_text", "text", "summary", "group")
    corpus.apply(leaving, 1)
    return corpus.search(QUERY, 20, before, digits=9).select("id", r6(F.col("score")).alias("score"))
