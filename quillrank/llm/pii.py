"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Entities that regular expressions find are the seeds. The words left of an entity are a lexical pattern; every token that
looks like an identifier (it has a digit or an @) is an instance of the pattern left of it. Patterns and instances form a
graph. In each round a pattern's confidence in a kind is the mean score of its distinct instances (seeds of the kind 1,
other seeds 0, unknown tokens what they have so far), and an unknown token of a fitting shape scores one minus the product
of the doubts of its patterns. Patterns with enough distinct seeds and confidence then mark tokens that no expression found.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, let, materialise, scratch

#: Kinds in order, with expressions that give the same matches as the plain ones but never backtrack: possessive
#: repeats, and no search from the middle of a run whose start has failed.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A token with a digit or an @.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What an unknown token must look like to be taken for a kind.
SHAPES = {"email": r"^[^@\s]+@[^@\s]+$", "ip": r"^(?=.*[0-9])[0-9a-fA-F]*(?:[.:][0-9a-fA-F]*){2,}$", "card": r"^(?:[0-9]-?){12,19}$", "phone": r"^\+?[(]?(?:[0-9][().-]*){7,15}$"}

#: So many characters left of a span its context is read from.
NEAR = 80

_ONE = "struct<kind:int,start:int,end:int,match:string,left:string>"
_SPAN = f"array<{_ONE}>"
#: Items of a part of a scan, and code points of a part of a text that is cut.
PART, CUT = 32, 256


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def _left(before: Column) -> Column:
    """The last two words of what stands before, lower-cased, digits as 9, spaces as one."""
    tail = F.regexp_extract(F.lower(F.right(before, F.lit(NEAR))), r"(?:\S+\s+)?\S+\s*$", 0)
    return F.regexp_replace(F.regexp_replace(tail, "[0-9]", "9"), r"\s+", " ")


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(state, item)`` of each item, where ``step(state, item)`` is the state that the next item meets; ``kind`` is the type emitted.

    An array that grows by one is copied each time, so states and results are handed on through parts of ``PART`` items
    and parts of parts: the work is in proportion to the items up to many millions.
    """

    def parts(of: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / PART).cast("int")), lambda k: F.slice(of, k * PART + 1, F.lit(PART)))

    def fold(of: Column, state: Column, each: Callable[[Column, Column], Column], out: str) -> Column:
        """State and results after ``of``; ``each(state, x)`` gives the state (s) and one result (o)."""
        first = F.struct(state.alias("s"), F.array().cast(f"array<{out}>").alias("o"))
        return F.aggregate(of, first, lambda acc, x: let(each(acc["s"], x), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o"))))

    one = lambda state, x: F.struct(step(state, x).alias("s"), emit(state, x).alias("o"))
    low = lambda state, part: fold(part, state, one, kind)
    high = lambda state, part: fold(part, state, low, f"array<{kind}>")
    whole = lambda some: fold(parts(parts(some)), zero, high, f"array<array<{kind}>>")["o"]
    return let(items, lambda some: F.when(F.size(some) > 0, F.flatten(F.flatten(whole(some)))).otherwise(F.array().cast(f"array<{kind}>")))


def found(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their code point offsets: what lies between matches and the matches have lengths that add up.

    ``left`` is the text before a match, its last ``NEAR`` characters, other matches included.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("g"), matches.alias("m")), lambda p: p["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    begin = lambda acc, p: acc["at"] + F.length(p["g"])
    tail = lambda *x: F.right(F.concat(*x), F.lit(NEAR))
    step = lambda acc, p: F.struct((begin(acc, p) + F.length(p["m"])).alias("at"), tail(acc["tail"], p["g"], p["m"]).alias("tail"))
    item = lambda acc, p: F.struct(F.lit(kind).alias("kind"), begin(acc, p).alias("start"), (begin(acc, p) + F.length(p["m"])).alias("end"), p["m"].alias("match"), tail(acc["tail"], p["g"]).alias("left"))
    return scan(pairs, start, step, item, _ONE)


def outside(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``, by binary search among the sorted starts and the largest ends so far."""
    by_start = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    largest = lambda acc, b: F.greatest(acc, b["end"])

    def free(starts: Column, ends: Column) -> Column:
        powers = F.filter(F.lit([1 << k for k in range(30, -1, -1)]), lambda p: p <= F.size(starts))

        def clear(s: Column) -> Column:
            before = F.aggregate(powers, F.lit(0), lambda lo, p: lo + F.when(F.get(starts, lo + p - 1) < s["end"], p).otherwise(F.lit(0)))
            return F.coalesce(F.get(ends, before - 1) <= s["start"], F.lit(True))

        return F.filter(spans, clear)

    # the powers are short, and computed for each span; the sorted arrays are not
    return let(by_start, lambda some: let(scan(some, F.lit(0), largest, largest, "int"), lambda ends: let(F.transform(some, lambda b: b["start"]), lambda starts: free(starts, ends))))


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the valid matches of its expression; texts that cannot hold one are not searched."""
    some = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){15}"),
        "phone": text.rlike(r"\+[0-9]"),
    }
    n = lambda s: F.length(digits(s["match"]))
    valid = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["match"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
        "card": lambda s: F.when(n(s).between(16, 19), luhn(digits(s["match"]))).otherwise(False),
        "phone": lambda s: n(s).between(8, 15),
    }
    none = F.array().cast(_SPAN)
    context = lambda s: s.withField("left", _left(s["left"]))
    return {k: F.when(some[k], F.transform(F.filter(found(text, PATTERNS[k], i), valid[k]), context)).otherwise(none) for i, k in enumerate(KINDS)}


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), a span array for each kind, and ``tokens``: identifier-like tokens outside of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = rows.select("doc_id", F.xxhash64("text").alias("th"), "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    spans = spans.withColumn("base", F.concat(*KINDS))
    raw = F.when(F.col("text").rlike("[0-9@]"), found(F.col("text"), TOKEN, -1)).otherwise(F.array().cast(_SPAN))

    def value(s: Column) -> Column:
        """The token without what is glued before its value, which joins the pattern, and without marks after it."""
        glued = F.regexp_extract(s["match"], r"^[^0-9@]*[=:\"'(\[<]", 0)
        body = F.regexp_replace(F.substring(s["match"], F.length(glued) + 1, F.length(s["match"])), r"[^\p{Alnum}]+$", "")
        start = s["start"] + F.length(glued)
        return F.struct(s["kind"].alias("kind"), start.alias("start"), (start + F.length(body)).alias("end"), body.alias("match"), _left(F.concat(s["left"], glued)).alias("left"))

    some = F.filter(F.transform(raw, value), lambda s: (F.length(s["match"]) > 0) & (s["left"] != ""))
    return spans.withColumn("tokens", outside(some, F.col("base"))).drop("text", "base")


def discover(extracted: DataFrame, **how) -> DataFrame | None:
    """What ``_discover`` finds, as a table of its own; the graph is deleted."""
    with scratch():
        found = _discover(extracted, **how)
        return None if found is None else keep(materialise(found, "found"))


def _discover(extracted: DataFrame, seeds: int = 5, confidence: float = 0.6, rounds: int = 3) -> DataFrame | None:
    """doc_id, th, kind, start, end of tokens that confident patterns mark, or None where no pattern has enough seeds.

    ``extracted`` is a written table. Repeats of an instance under a pattern count once, so copies prove nothing.
    """
    fields = ["doc_id", "th", "s.kind", "s.start", "s.end", "s.match", "s.left"]
    seen = extracted.select("doc_id", "th", F.explode(F.concat(*KINDS, "tokens")).alias("s")).select(*fields).where("left <> ''")
    graph = seen.select("left", "match", "kind").distinct()
    alive = graph.where("kind >= 0").groupBy("left", F.col("kind").alias("of")).agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= seeds)
    alive = materialise(alive, "patterns")
    if alive.isEmpty():
        return None
    size = graph.groupBy("left").agg(F.count(F.lit(1)).alias("n"))
    alive = materialise(alive.join(size, "left"), "patterns")
    shape = reduce(lambda rest, i: F.when((F.col("of") == i) & F.col("match").rlike(SHAPES[KINDS[i]]), True).otherwise(rest), range(len(KINDS)), F.lit(False))
    unknown = materialise(graph.where("kind < 0").join(alive.select("left", "of"), "left").select("left", "match", "of").where(shape), "instances")
    score = alive.select("left", "of", (F.col("seeds") / F.col("n")).alias("conf"))
    for _ in range(rounds):
        doubt = F.sum(F.log(F.lit(1.0) - F.least(F.col("conf"), F.lit(0.999))))
        instance = unknown.join(score, ["left", "of"]).groupBy("match", "of").agg((F.lit(1.0) - F.exp(doubt)).alias("s"))
        gained = unknown.join(instance, ["match", "of"]).groupBy("left", "of").agg(F.sum("s").alias("gain"))
        score = materialise(alive.join(gained, ["left", "of"], "left").select("left", "of", ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / F.col("n")).alias("conf")), "scores")
    best = score.where(F.col("conf") >= confidence)
    marks = unknown.join(best, ["left", "of"]).groupBy("left", "match").agg(F.max_by("of", F.struct("conf", -F.col("of"))).alias("of"))
    tokens = seen.where("kind < 0").join(marks, ["left", "match"])
    return tokens.select("doc_id", "th", F.col("of").alias("kind"), "start", "end").distinct()


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def annotate(docs: DataFrame, **how) -> DataFrame:
    """doc_id, th, base and all (arrays of kind, start, end by kind and start), and the count of each kind's base spans."""
    got = materialise(extract(docs), "pii")
    plain = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    rows = got.select("doc_id", "th", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], plain(F.concat(*KINDS)).alias("base"))
    more = discover(got, **how)
    if more is None:
        return rows.withColumn("all", F.col("base"))
    more = more.groupBy(F.col("doc_id").alias("more_id"), F.col("th").alias("more_th")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    joined = rows.join(more, F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("th") == F.col("more_th")), "left").drop("more_id", "more_th")
    return joined.withColumn("all", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))).drop("more")


def digest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``docs``.

    Offsets count code points, ends are exclusive. Null texts are empty, empty texts have no spans (the hash is that of
    the empty string); null ids stay; repeated rows give repeated results; an empty table gives no rows; other columns
    are ignored. Base spans of one kind never overlap; spans of different kinds may.
    """
    return annotate(docs, **how).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("all")).alias("spans"))


def redact(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with each span (overlapping ones as one, named by the first) replaced by its kind in brackets.

    ``n_chars``, where there is one, follows the new text. Rows without spans are unchanged.
    """
    spans = annotate(docs, **how).where(F.size("all") > 0).select(F.col("doc_id").alias("_pii_id"), F.col("th").alias("_pii_th"), F.col("all").alias("_pii_all")).dropDuplicates(["_pii_id", "_pii_th"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_pii_id")) & (F.xxhash64(text) == F.col("_pii_th"))
    kind = "struct<start:int,end:int,kind:int>"
    by_start = F.array_sort(F.transform("_pii_all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.lit(-1)
    longer = lambda acc, s: F.struct(acc["start"].alias("start"), F.greatest(acc["end"], s["end"]).alias("end"), acc["kind"].alias("kind"))
    joined = lambda acc, s: F.when(acc["end"] > s["start"], longer(acc, s)).otherwise(s)
    grown = scan(by_start, F.struct(none.alias("start"), none.alias("end"), none.alias("kind")), joined, joined, kind)
    apart = let(grown, lambda g: F.filter(g, lambda s, i: F.coalesce(F.get(g, i + 1)["start"] != s["start"], F.lit(True))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def between(parts: Column, start: Column, end: Column) -> Column:
        """The text from ``start`` to ``end`` of a text in parts of ``CUT`` code points."""
        lo, hi = F.floor(start / CUT).cast("int"), F.floor(end / CUT).cast("int")
        piece = lambda k, at, n: F.coalesce(F.substring(F.get(parts, k), at, n), F.lit(""))
        across = F.concat(piece(lo, start % CUT + 1, F.lit(CUT)), F.array_join(F.slice(parts, lo + 2, hi - lo - 1), ""), piece(hi, F.lit(1), end % CUT))
        return F.when(lo == hi, piece(lo, start % CUT + 1, end - start)).otherwise(across)

    def rebuilt(parts: Column, cuts: Column, n: Column) -> Column:
        before = lambda i: F.coalesce(F.get(cuts, i - 1)["end"], F.lit(0))
        kept = F.transform(cuts, lambda s, i: F.concat(between(parts, before(i), s["start"]), F.element_at(names, s["kind"] + 1)))
        return F.concat(F.array_join(kept, ""), between(parts, before(F.size(cuts)), n))

    in_parts = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    new = let(in_parts, lambda parts: let(apart, lambda cuts: let(F.length("text"), lambda n: rebuilt(parts, cuts, n))))
    rows = docs.join(spans, same, "left")
    rows = rows.withColumn("text", F.when(F.col("_pii_all").isNotNull(), new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_pii_all").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
