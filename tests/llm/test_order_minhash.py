"""Order MinHash against its definition in plain integers, and the order of documents with ties and null ids."""

import hashlib
import random

from pyspark.sql import functions as F

from quillrank.llm import order_minhash as O

FULL = (1 << 64) - 1
M1, M2, GOLD, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x):
    x = (x ^ (x >> 30)) * M1 & FULL
    x = (x ^ (x >> 27)) * M2 & FULL
    return x ^ (x >> 31)


def window(text, at, width):
    """Hash of the characters of one window, doubling its width and stepping to the rest."""
    if width == 1:
        return ord(text[at]) * GOLD & FULL
    half = 1
    while half * 2 < width:
        half *= 2
    x = (window(text, at, half) * STEP + window(text, at + width - half, half)) & FULL
    return x ^ (x >> 32)


def plain(text, k=8, sketches=64, each=2):
    if not text:
        return [0] * sketches
    k, seen, entries = min(k, len(text)), {}, [[] for _ in range(sketches)]
    for at in range(len(text) - k + 1):
        same = mix(window(text, at, k)) >> 26
        number = seen[same] = seen.get(same, -1) + 1
        pair = mix((same * GOLD + number * M2) & FULL)
        entries[pair >> (65 - sketches.bit_length())].append((pair, at))
    out = []
    for pairs in entries:
        least = sorted(sorted(pairs)[:each], key=lambda p: p[1])
        x = 0
        for p in [p for p, _ in least] + [0] * (each - len(least)):
            x = mix((x * 31 + p) & FULL)
        out.append(max(x & 0xFFFFFFFF, 1) if least else 0)
    return out


def test_signature_against_its_definition():
    rng = random.Random(2)
    for n in (0, 1, 7, 8, 9, 60, 900, 4000):
        text = "".join(rng.choices("abé😀 ", k=n))
        assert O.signature(text).tolist() == plain(text)
    text = "abcd" * 700  # occurrence numbers
    assert O.signature(text).tolist() == plain(text)
    assert O.signature(text, k=5, sketches=16, each=3).tolist() == plain(text, 5, 16, 3)


def test_next_documents_with_ties_and_null_ids(spark):
    """A third of the rows has no id, another third one id; ranges of a few rows."""
    rng = random.Random(8)
    rows = [((None, 5, rng.randrange(40))[k % 3], " ".join(rng.choices(["ab", "cd", "ef"], k=rng.randint(0, 9)))) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = []
    for k, (d, text) in enumerate(order):
        edited = O.edit(text, order[(k + 1) % len(order)][1])
        want.append((-1 if d is None else d, hashlib.sha256(edited.encode()).hexdigest(), O.fingerprint(text), O.fingerprint(edited)))
    for per in (1000, 7):
        got = O.fingerprints(frame, rows_per_range=per).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == sorted(want)
