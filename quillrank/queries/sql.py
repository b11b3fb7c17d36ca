"""DuckDB SQL that states what the library's queries return, built from a few shared fragments."""

from __future__ import annotations

ITEMS = {
    "part": "SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS id, p_name AS primary_text, p_brand || ' ' || p_type AS text, p_brand AS grp FROM part",
    "documents": "SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, source AS primary_text, text, lang AS grp FROM documents",
    "pages": "SELECT page_id AS pos, CAST(page_id AS VARCHAR) AS id, url AS primary_text, html AS text, CAST(NULL AS VARCHAR) AS grp FROM pages",
    "conversations": "SELECT conv_id * 10000 + turn AS pos, conv_id || ':' || turn AS id, role AS primary_text, text, CAST(conv_id AS VARCHAR) AS grp FROM conversations",
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(x: str) -> str:
    parted = rf"regexp_replace(regexp_replace({x}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return rf"list_transform(regexp_extract_all({parted}, '[\p{{L}}\p{{N}}]+(?:[.''][\p{{L}}\p{{N}}]+)*'), lambda t: lower(t))"


def joined(tokens_: str) -> str:
    return f"array_to_string({tokens_}, ' ')"


def trigrams(s: str) -> str:
    return f"list_transform(range(1, greatest(length({s}) - 1, 1)), lambda i: substring({s}, i, 3))"


def trigram_set(s: str) -> str:
    return f"list_distinct({trigrams(s)})"


def dice(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0::DOUBLE END)"


def docs(items: str) -> str:
    """CTEs ``items``, ``toks`` and ``docs`` (tokens, length, canonical texts, trigram sets)."""
    return f"""items AS ({ITEMS.get(items, items)}),
toks AS (SELECT *, {tokens("primary_text")} AS p, {tokens("text")} AS b FROM items),
canon AS (SELECT *, len(p) + len(b) AS doc_len, {joined("p")} AS pc, {joined("b")} AS bc FROM toks),
docs AS (SELECT *, {trigram_set("pc")} AS pt, {trigram_set("bc")} AS bt FROM canon)"""


POSTS = """posts AS (SELECT pos, term, sum(w) AS tf FROM (SELECT pos, unnest(p) AS term, 5::DOUBLE AS w FROM docs UNION ALL SELECT pos, unnest(b), 1::DOUBLE FROM docs) GROUP BY pos, term),
stats AS (SELECT count(*)::DOUBLE AS n, coalesce(avg(doc_len), 0)::DOUBLE AS avgdl FROM docs)"""
IDF = "ln(1::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
NORM = "1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl)"
PART = f"{IDF} * tf * 2.2::DOUBLE / (tf + {NORM})"


def bm25(query: str) -> str:
    """CTEs ``posts``, ``stats``, ``terms``, ``df`` and ``bm`` (pos, s) after ``docs``."""
    return f"""{POSTS},
terms AS (SELECT DISTINCT unnest({tokens(quoted(query))}) AS term),
df AS (SELECT term, count(*)::DOUBLE AS df FROM posts JOIN terms USING (term) GROUP BY term),
bm AS (SELECT pos, sum({PART}) AS s FROM posts JOIN df USING (term) JOIN docs USING (pos) CROSS JOIN stats GROUP BY pos)"""


COSINE = "round(coalesce(list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0), 4)"


def scored(items: str, query: str, weights: tuple[float, float, float] = (1, 1, 1), vectors: bool = False) -> str:
    """All CTEs up to ``scored``: pos, id, text, raw signals, ranks, and score (null for rows that no list ranks)."""
    cos = COSINE if vectors else "0::DOUBLE"
    other = "LEFT JOIN embeddings v ON CAST(v.vec_id AS VARCHAR) = docs.id" if vectors else ""
    names = ("bm25", "trigram", "cosine")
    rank = ", ".join(f"CASE WHEN {s} > 0 THEN row_number() OVER (PARTITION BY {s} > 0 ORDER BY {s} DESC, pos) - 1 END AS rank_{s}, max({s}) OVER () > 0 AS has_{s}" for s in names)
    used = [(s, w) for s, w in zip(names, weights, strict=True) if w > 0]
    total = " + ".join(f"coalesce({float(w)}::DOUBLE / (60::DOUBLE + rank_{s}), 0)" for s, w in used) or "0::DOUBLE"
    ceiling = " + ".join(f"CASE WHEN has_{s} THEN {float(w)}::DOUBLE / 60 ELSE 0 END" for s, w in used) or "0::DOUBLE"
    ranked = " OR ".join(f"rank_{s} IS NOT NULL" for s, _ in used) or "FALSE"
    gram = quoted(query)
    return f"""{docs(items)},
{bm25(query)},
qt AS (SELECT {trigram_set("c")} AS g FROM (SELECT {joined(tokens(gram))} AS c)),
sig AS (SELECT docs.pos, docs.id, docs.text, round(coalesce(s, 0), 9) AS bm25, round(5 * {dice("g", "pt")} + {dice("g", "bt")}, 9) AS trigram, {cos} AS cosine
  FROM docs LEFT JOIN bm ON docs.pos = bm.pos CROSS JOIN qt {other}),
ranked AS (SELECT *, {rank} FROM sig),
scored AS (SELECT *, CASE WHEN {ranked} THEN round(({total}) / ({ceiling}), 9) END AS score FROM ranked)"""


def top(items: str, query: str, limit: int | None = 50, columns: str = "id, score, bm25, trigram, cosine", **how) -> str:
    cut = "" if limit is None else f"ORDER BY score DESC, pos LIMIT {limit}"
    return f"WITH {scored(items, query, **how)}\nSELECT {columns} FROM scored WHERE score IS NOT NULL {cut}"


def full(items: str, query: str, **how) -> str:
    """CTEs up to ``placed``: every row with its place in the full ordering."""
    return f"""{scored(items, query, **how)},
placed AS (SELECT id, text, coalesce(score, 0) AS score, bm25, trigram, cosine, row_number() OVER (ORDER BY score IS NULL, score DESC, pos) - 1 AS place FROM scored)"""
