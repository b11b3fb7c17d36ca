"""Tokens and trigram sets of many texts at a time, over arrays of characters; the same as ``text`` gives, at a fraction of the work.

Only texts of Latin letters and common punctuation are cut here. ``prepared`` marks the others and adds their tokens and
trigram sets by the column expressions, so that Unicode properties come from one place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import char_trigrams, tokenize

_WORD, _LOWER, _UPPER, _GLUE = 1, 2, 4, 8
#: Letters whose properties are those of all Unicode versions; one has a lower case of two code points.
_KNOWN = [c for c in range(0x180) if c != 0x130]
_WIDE = r"[^\x00-\u017F]"
_OTHER = r"[^\x00-\u012F\u0131-\u017F\u2010-\u2027\u20AC]"
#: Characters of texts that are handled at a time, which bounds the memory of a Python worker.
CHUNK = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point its class and the number of its lower case; by number the code point. Number 0 is the space."""
    kinds, lower = np.zeros(0x180, np.uint8), np.zeros(0x180, np.uint8)
    chars = {" ": 0, ".": 1, "'": 2}
    for c in _KNOWN:
        kind = unicodedata.category(chr(c))
        if kind[0] in "LN":
            kinds[c] = _WORD | (_LOWER if kind == "Ll" or c in (0xAA, 0xBA) else 0) | (_UPPER if kind == "Lu" else 0)
            lower[c] = chars.setdefault(chr(c).lower(), len(chars))
    for c in ".'":
        kinds[ord(c)], lower[ord(c)] = _GLUE, chars[c]
    return kinds, lower, np.array([ord(c) for c in chars], np.uint32)


_KINDS, _NUMBERS, _CHARS = _tables()
BASE = len(_CHARS)


def prepared(items: DataFrame, *columns: str) -> DataFrame:
    """Columns of ``items`` with both texts as ``features`` reads them; tokens and sets are null but for other scripts."""

    def other(c: Column) -> Column:
        """Whether characters are unknown here; the cheaper tests come first."""
        wide = (F.octet_length(c) != F.length(c)) & ((c.rlike(_WIDE) & c.rlike(_OTHER)) | F.contains(c, F.lit("\u0130")))
        return F.coalesce(wide, F.lit(True))

    rows = items.select(*columns, *[c for c in ("primary_text", "text") if c not in columns])
    rows = rows.withColumns({"_po": other(F.col("primary_text")), "_bo": other(F.col("text"))})
    rows = rows.withColumns({"_p": F.when(F.col("_po"), tokenize(F.col("primary_text"))), "_b": F.when(F.col("_bo"), tokenize(F.col("text")))})
    return rows.withColumns({f"_{f}g": F.array_distinct(char_trigrams(F.array_join(f"_{f}", " "))) for f in "pb"})


@dataclass
class Field:
    """A field of a row: tokens (null for a null text), and the set of trigrams as numbers, or as strings for other scripts."""

    tokens: list[str] | None
    grams: np.ndarray | list[str]


def gram_number(gram: str) -> int:
    """The number of a trigram, -1 if it has other characters than ``features`` numbers."""
    at = [np.flatnonzero(_CHARS == ord(c)) for c in gram]
    return int((at[0][0] * BASE + at[1][0]) * BASE + at[2][0]) if len(gram) == 3 and all(len(a) for a in at) else -1


def gram_texts(numbers: np.ndarray) -> list[str]:
    flat = _CHARS[np.stack([numbers // (BASE * BASE), numbers // BASE % BASE, numbers % BASE], 1).ravel()].astype("<u4").tobytes().decode("utf-32-le")
    return [flat[i : i + 3] for i in range(0, len(flat), 3)]


_first = None


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Numbers without repeats, in order of first occurrence."""
    global _first
    if _first is None:
        _first = np.zeros(BASE**3, np.int32)
    n = np.arange(len(numbers), dtype=np.int32)
    _first[numbers[::-1]] = n[::-1]  # of several writes to one place the last one stays
    return numbers[_first[numbers] == n]


def cut(texts: list[str], grams: bool = True) -> list[Field]:
    """Tokens and trigram sets of texts of known characters (others count as borders of tokens)."""
    if not texts:
        return []
    lengths = np.array([len(t) + 1 for t in texts])
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 0x180, codes, 0).astype(np.int16)
    kinds = _KINDS[codes]
    word, low, up = (kinds & _WORD) != 0, (kinds & _LOWER) != 0, (kinds & _UPPER) != 0
    keep, start = word.copy(), np.zeros(len(codes), bool)
    keep[1:-1] |= ((kinds[1:-1] & _GLUE) != 0) & word[:-2] & word[2:]
    start[1:] = low[:-1] & up[1:]
    start[1:-1] |= up[:-2] & up[1:-1] & low[2:]
    start[1:] |= ~keep[:-1]
    start[0] = True
    at = np.flatnonzero(keep)
    starts = np.concatenate([[0], np.cumsum(start[at])])
    out = np.zeros(len(at) + starts[-1], np.uint8)
    out[np.arange(len(at)) + starts[1:]] = _NUMBERS[codes[at]]
    ends = np.searchsorted(at, np.cumsum(lengths))
    ends = (ends + starts[ends]).tolist()
    whole = _CHARS[out].astype("<u4").tobytes().decode("utf-32-le")
    wide = out.astype(np.int32)
    numbers = (wide[:-2] * BASE + wide[1:-1]) * BASE + wide[2:]
    found, begin, none = [], 0, numbers[:0]
    for end in ends:  # a text's terms, each after a space
        found.append(Field(whole[begin + 1 : end].split(" ") if end > begin else [], _distinct(numbers[begin + 1 : end - 2]) if grams and end - begin > 3 else none))
        begin = end
    return found


def chunks(batch) -> Iterator:
    """Slices of a record batch of some ``CHUNK`` characters."""
    import pyarrow.compute as pc

    size = np.cumsum(sum(np.asarray(pc.fill_null(pc.utf8_length(batch.column(c)), 0)).astype(np.int64) for c in ("primary_text", "text")) + 16) // CHUNK
    at = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at, at[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def features(batch, grams: bool = True) -> tuple[list[Field], list[Field]]:
    """Primary and body fields of a record batch of ``prepared`` rows."""
    both = []
    for f, c in (("p", "primary_text"), ("b", "text")):
        other = batch.column(f"_{f}o").to_pylist()
        got = cut([t if not o else "" for t, o in zip(batch.column(c).to_pylist(), other, strict=True)], grams)
        if any(other):
            tokens, sets = batch.column(f"_{f}"), batch.column(f"_{f}g")
            for i, o in enumerate(other):
                if o:
                    got[i] = Field(tokens[i].as_py(), sets[i].as_py() or [])
        both.append(got)
    return both[0], both[1]
