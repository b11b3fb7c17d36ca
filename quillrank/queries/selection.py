"""Queries of the selection step, with a scripted session in a model's place."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators.ranker import full_ordering
from ..operators.ranking import SIGNALS
from ..plans import selection as P
from ..plans.diagnostics import RetrievalCut
from ..plans.searcher import Searcher
from ..sources import items as I
from . import sql
from .common import DIGITS, QUERY, part, query, r6, table

PREAMBLE = "Choose items."


class Scripted(P.BaseSession):
    """Answers every prompt with the same ids."""

    def __init__(self, ids):
        self.raw = json.dumps({"ids": list(ids)})

    def respond(self, prompt: str) -> str:
        return self.raw


def _picks(places: list[int]):
    """A session that picks offered ids by their place, the first of them twice and an unknown one in between."""

    def model(prefix: str, grammar: str) -> Scripted:
        offered = json.loads(grammar)["properties"]["ids"]["items"]["enum"]
        ids = [offered[p] for p in places if p < len(offered)]
        return Scripted(ids[:1] + ["nobody"] + ids)

    return model


def _nation_items(spark, sf_dir):
    return I.items(table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_name"), F.col("n_nationkey"))


NATIONS = "SELECT n_nationkey AS pos, CAST(n_nationkey AS VARCHAR) AS id, CAST(n_nationkey AS VARCHAR) AS primary_text, n_name AS text, CAST(NULL AS VARCHAR) AS grp FROM nation"
PICKED = ["7", "2", "7", "99", "0"]


def _chosen(ids: list[str], limit: int | None = None) -> str:
    rows = ", ".join(f"({i}, {sql.quoted(x)})" for i, x in enumerate(ids))
    cut = "" if limit is None else f"WHERE rank < {limit}"
    return f"""chosen AS (SELECT id, min(k) AS k FROM (VALUES {rows}) AS v(k, id) GROUP BY id),
accepted AS (SELECT row_number() OVER (ORDER BY k) - 1 AS rank, p.* FROM chosen c JOIN placed p USING (id)),
answer AS (SELECT rank, id, text AS block, round(score, 6) AS score FROM accepted {cut})"""


def _answer(df):
    return df.select(F.col("rank").cast("long").alias("rank"), "id", "block", r6(F.col("score")).alias("score"))


@query("selection_scripted", f"WITH {sql.full(NATIONS, 'nation 7')}, {_chosen(PICKED)} SELECT * FROM answer")
def selection_scripted(spark, sf_dir):
    return _answer(Searcher(_nation_items(spark, sf_dir), session=lambda _prefix: Scripted(PICKED), preamble=PREAMBLE, digits=DIGITS).search("nation 7"))


@query("selection_limit", f"WITH {sql.full(NATIONS, 'nation 7')}, {_chosen(PICKED, 2)} SELECT * FROM answer")
def selection_limit(spark, sf_dir):
    return _answer(Searcher(_nation_items(spark, sf_dir), session=lambda _prefix: Scripted(PICKED), preamble=PREAMBLE, digits=DIGITS).search("nation 7", 2))


def _over_budget(spark, sf_dir, sink=lambda _: None):
    corpus = part(spark, sf_dir)
    config = P.SelectionConfig(_picks([2, 0, 5]), PREAMBLE, capacity=100)
    return P.SelectionTier(corpus, config, lambda q: full_ordering(corpus, q, digits=DIGITS), sink).search(QUERY)


@query("selection_over_budget", f"WITH {sql.full('part', QUERY)} SELECT CASE place WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS rank, id, text AS block, round(score, 6) AS score FROM placed WHERE place IN (0, 2, 5)")
def selection_over_budget(spark, sf_dir):
    return _answer(_over_budget(spark, sf_dir))


@query("retrieval_cut", "SELECT count(*)::BIGINT AS considered, least(count(*), 24)::BIGINT AS kept FROM part")
def retrieval_cut(spark, sf_dir):
    told = []
    _over_budget(spark, sf_dir, told.append)
    return spark.createDataFrame([(d.considered, d.kept) for d in told if isinstance(d, RetrievalCut)], "considered long, kept long")


IDS = ["12", "5", "12", "nobody", "3"]
CHOSEN = ", ".join(f"({i}, '{x}')" for i, x in enumerate(IDS))


@query("selection_lookup", f"WITH {sql.full('part', QUERY)}, {_chosen(IDS)} SELECT a.rank, a.id, a.block, a.score, {', '.join(f'round(p.{s}, 6) AS {s}' for s in SIGNALS)} FROM answer a JOIN placed p USING (id)")
def selection_lookup(spark, sf_dir):
    corpus = part(spark, sf_dir)
    rows = P.match_ids(corpus, full_ordering(corpus, QUERY, digits=DIGITS), IDS, 20)
    return rows.select(F.col("rank").cast("long").alias("rank"), "id", "block", *[r6(F.col(c)).alias(c) for c in ("score", *SIGNALS)])


@query("selection_dedupe", f"SELECT id, min(k)::BIGINT AS place FROM (VALUES {CHOSEN}) AS v(k, id) GROUP BY id")
def selection_dedupe(spark, sf_dir):
    rows = spark.createDataFrame([(json.dumps({"ids": IDS}),)], "raw string").select(F.posexplode(F.from_json("raw", "ids array<string>")["ids"]).alias("place", "id"))
    return rows.groupBy("id").agg(F.min("place").cast("long").alias("place"))


@query("selection_unknown_ids", f"SELECT DISTINCT id FROM (VALUES {CHOSEN}) AS v(k, id) WHERE id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)")
def selection_unknown_ids(spark, sf_dir):
    ids = spark.createDataFrame([(x,) for x in IDS], "id string").distinct()
    return ids.join(part(spark, sf_dir).select("id"), "id", "left_anti")


@query("selection_decode", "SELECT item_id, 'id-' || item_id AS id FROM benchmark")
def selection_decode(spark, sf_dir):
    raw = table(spark, sf_dir, "benchmark").select("item_id", F.to_json(F.struct(F.array(F.concat(F.lit("id-"), F.col("item_id"))).alias("ids"))).alias("raw"))
    return raw.select("item_id", F.explode(F.from_json("raw", "ids array<string>")["ids"]).alias("id"))


@query("assemble_prefix", f"SELECT '{PREAMBLE}' || chr(10) || chr(10) || '# Candidates' || chr(10) || string_agg(n_name, chr(10) || chr(10) ORDER BY n_nationkey) AS prefix FROM nation")
def assemble_prefix(spark, sf_dir):
    return P.assemble_prefix(_nation_items(spark, sf_dir), PREAMBLE)


@query("prefix_budget", f"SELECT ({len(PREAMBLE)} + 15 + sum(length(p_brand || ' ' || p_type)) + 2 * (count(*) - 1))::BIGINT AS length FROM part")
def prefix_budget(spark, sf_dir):
    return P.prefix_length(I.part_items(spark, sf_dir), PREAMBLE)


GRAMMAR = """SELECT '{"type": "object", "properties": {"ids": {"type": "array", "items": {"type": "string", "enum": ['
  || string_agg('"' || n_nationkey || '"', ', ' ORDER BY n_nationkey) || ']}, "uniqueItems": true, "maxItems": ' || count(*) || '}}, "required": ["ids"]}' AS grammar FROM nation"""


@query("id_enum_grammar", GRAMMAR)
def id_enum_grammar(spark, sf_dir):
    """The answer's schema for a small catalog: its ids come to the driver, as the prefix's do."""
    ids = [r.id for r in _nation_items(spark, sf_dir).orderBy("pos").select("id").collect()]
    return spark.createDataFrame([(P.id_enum_grammar(ids),)], "grammar string")
