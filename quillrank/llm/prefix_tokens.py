"""Exact token counts at every prefix by dynamic programming.

The pre-tokenizer never lets a piece cross from a non-space to a following space, so a text is cut there into segments
that are encoded apart; the count at a prefix is the count at the start of its segment plus a count inside the segment.
Inside a piece, the last token of a prefix's encoding is the only token that ends there and is compatible with the last
token of the prefix before it, so ``last[i]`` and ``count[i]`` follow from shorter prefixes: one pass gives the count at
every prefix. Segments repeat, so their tables are kept in a bounded cache; a text is never encoded again to answer a
truncation or budget question.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space, as the pre-tokenizer has it.
SPACE = " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A segment: spaces, then what is not space. Text at the end may be spaces alone.
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
LEADING = re.compile(f"[{SPACE}]*")
#: Contractions that are no piece without their last letter.
SPLIT_EARLY = ("'re", "'ve", "'ll")
CACHE = 300_000


class Known(dict):
    """Counts of strings, each made by ``count`` when first asked for; strings of up to 64 characters are kept, a bounded number."""

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def __missing__(self, text: str) -> int:
        n = self.count(text)
        if len(text) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[text] = n
        return n


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


class PrefixCounter:
    """Counts of a byte-level BPE vocabulary; ``path`` is a tokenizer's .json file."""

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        chars = _byte_chars()
        back = {c: b for b, c in chars.items()}
        decode = lambda token: "".join(chr(back[c]) for c in token)  # noqa: E731  latin-1 text of its bytes
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in set(self.special)}
        self.of = {decode(t): i for t, i in vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        size = max(vocab.values()) + 1
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.made_at = [-1] * size  # rank of the merge that makes a token; -1: a single byte
        for (a, b), (r, ab) in self.rank.items():
            if self.made_at[ab] < 0:
                self.parts[ab], self.made_at[ab] = (a, b), r
        self.length = [0] * size
        for t, i in self.of.items():
            self.length[i] = len(t)
        self.find = ahocorasick.Automaton()
        for t, i in self.of.items():
            if self.bpe(t) == [i]:  # a token that no encoding reaches is never a last token
                self.find.add_word(t, i)
        self.find.make_automaton()
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.tables: dict[str, tuple[int, ...]] = {}
        self.pieces = Known(lambda piece: self.piece_counts(piece.encode().decode("latin-1"))[-1])
        self.totals = Known(lambda segment: sum(map(self.pieces.__getitem__, PIECE.findall(segment))))

    def bpe(self, piece: str) -> list[int]:
        """Plain merging of a piece (latin-1 text of its bytes), lowest rank first."""
        ids = [self.of[c] for c in piece]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 60, 0)) + (k,) for k, p in enumerate(zip(ids, ids[1:], strict=False))), default=None)
            if best is None or best[0] == 1 << 60:
                break
            a, b = ids[best[2]], ids[best[2] + 1]
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and ids[k] == a and ids[k + 1] == b:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the tokens ``left`` and ``right`` apart where they stand side by side.

        Undo merges from the latest to the earliest: a merge across the border would have come first exactly if its
        rank is below those of the merges that made its two sides what they are.
        """
        got = self.pair_ok.get((left, right))
        if got is not None:
            return got
        a, b, before, rank, made, parts = left, right, 1 << 60, self.rank, self.made_at, self.parts
        ok = True
        while True:
            across = rank.get((a, b))
            if across is not None and across[0] < before:
                ok = False
                break
            # the side made later is undone first; of two made by the same merge, the left was made first
            if made[a] < 0 and made[b] < 0:
                break
            if made[a] > made[b]:
                before, a = made[a], parts[a][1]
            else:
                before, b = made[b] + (made[b] >= 0), parts[b][0]
        if len(self.pair_ok) > 2_000_000:
            self.pair_ok.clear()
        self.pair_ok[left, right] = ok
        return ok

    def piece_counts(self, raw: str) -> list[int]:
        """Token counts of the first 0, 1, ... bytes of one piece."""
        n = len(raw)
        count, last, length, ok = [0] * (n + 1), [-1] * (n + 1), self.length, self.pair_ok
        at = 0
        for end, token in self.find.iter(raw):
            end += 1
            if end == at:
                continue  # this prefix has its last token
            start = end - length[token]
            if start:
                before = last[start]
                fits = ok.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            count[end], last[end], at = count[start] + 1, token, end
        return count

    def inside(self, piece: str) -> list[int]:
        """Token counts of the first 1, 2, ... code points of one piece."""
        raw = piece.encode()
        counts = self.piece_counts(raw.decode("latin-1"))
        if len(raw) == len(piece):
            return counts[1:]
        ends = [k for k in range(1, len(raw)) if raw[k] & 192 != 128] + [len(raw)]
        return [counts[k] for k in ends]

    def segment_table(self, segment: str) -> tuple[int, ...]:
        """Counts of the first 0, 1, ... code points of a segment.

        A prefix of a piece is one piece and has the piece's own counts, with two exceptions: a run of spaces before a
        word is two pieces, but one while the prefix ends inside it, and a contraction of three characters that lacks
        its last one is a mark and a letter.
        """
        got = self.tables.get(segment)
        if got is not None:
            return got
        out, done = [0], 0
        for m in PIECE.finditer(segment):
            piece = m.group()
            inside = self.inside(piece)
            if piece in SPLIT_EARLY:
                inside[1] = sum(self.inside(c)[-1] for c in piece[:2])
            out += [done + k for k in inside]
            done += inside[-1]
        spaces = LEADING.match(segment).end()
        if spaces:
            out[1 : spaces + 1] = self.inside(segment[:spaces])
        if len(segment) <= 64:
            if len(self.tables) >= CACHE // 4:
                self.tables.clear()
            self.tables[segment] = tuple(out)
        return tuple(out)

    def chunks(self, text: str) -> Iterator[tuple[str, bool]]:
        """The parts of a text between special strings, and those strings (True)."""
        if self.split_special is None:
            yield text, False
            return
        at = 0
        for m in self.split_special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def total(self, text: str) -> int:
        of = self.totals.__getitem__
        return sum(1 if special else sum(map(of, SEGMENT.findall(part))) for part, special in self.chunks(text))

    def total_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and ``longest_prefix`` of it, segments counted once."""
        if self.split_special is not None and self.split_special.search(text):
            n = self.total(text)
            return n, len(text) if n <= budget else self.longest_prefix(text, budget)
        segments = SEGMENT.findall(text)
        counts = list(map(self.totals.__getitem__, segments))
        n = sum(counts)
        if n <= budget:
            return n, len(text)
        done = k = 0
        while done + counts[k] <= budget:
            done += counts[k]
            k += 1
        table = self.segment_table(segments[k])
        return n, sum(map(len, segments[:k])) + max(i for i, x in enumerate(table) if done + x <= budget)

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of the first 0, 1, ... code points of ``text``, each exact for that prefix encoded alone.

        Special strings count as one token where they are whole; a prefix that cuts one holds its letters.
        """
        out, tail, before = [0], "", 0  # the last segment, and the count where it starts
        for part, special in self.chunks(text):
            if special:
                base = out[-1]
                out += [before + self.letters(tail + part[:k]) for k in range(1, len(part))] + [base + 1]
                tail, before = "", out[-1]
                continue
            for s in SEGMENT.findall(part):
                tail, before = s, out[-1]
                out += [before + k for k in self.segment_table(s)[1:]]
        return out

    def letters(self, text: str) -> int:
        """Tokens of a text in which special strings are ordinary letters."""
        return sum(self.totals[s] for s in SEGMENT.findall(text))

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens, from the table at segment borders.

        A count can fall by one or two when a letter is added but not below the count at the border before, so the
        search ends at the first border beyond the budget.
        """
        done = chars = best = before = 0
        tail = ""
        for part, special in self.chunks(text):
            for s in [part] if special else SEGMENT.findall(part):
                if done > budget:
                    return best
                n = 1 if special else self.totals[s]
                if special:
                    cut = [k for k in range(1, len(s)) if before + self.letters(tail + s[:k]) <= budget]
                    best = max([best, *(chars + k for k in cut)])
                elif done + n > budget:
                    table = self.segment_table(s)
                    best = max([best, *(chars + k for k in range(len(table)) if done + table[k] <= budget)])
                if done + n <= budget:
                    best = chars + len(s)
                tail, before = ("", done + n) if special else (s, done)
                done, chars = done + n, chars + len(s)
        return best


_OPEN: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, one in each process."""
    if path not in _OPEN:
        _OPEN[path] = PrefixCounter(path)
    return _OPEN[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (code points of the longest prefix within ``limit`` tokens).

    One row for each row of ``docs``; null texts are empty, empty ones have no tokens; null ids stay; an empty table
    gives no rows; other columns are ignored. ``path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens, fit = zip(*[c.total_and_fit(t, limit) for t in texts], strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts: the exact token count at every prefix (array of n_chars + 1 ints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, 64, 1 << 20):
            counts = [c.prefix_counts(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, counts array<int>")
