import pytest

from quillrank.functions.similarity import dice
from quillrank.functions.text import canonical_trigrams, char_trigrams, evaluate, grapheme_trigrams, tokenize
from pyspark.sql import functions as F

TOKENS = {
    "fetchRowById": "fetch row by id",
    "fetch_row_by_id": "fetch row by id",
    "parseXMLNode": "parse xml node",
    "md5_sum": "md5 sum",
    "utf16": "utf16",
    "can't": "can't",
    ".bar.": "bar",
    "a.'b": "a b",
    "- _ --": "",
    "": "",
    "Pkg.subName": "pkg.sub name",
    "let x = load_all() -> Item": "let x load all item",
    "dup dup one": "dup dup one",
    "Größe_maxWert": "größe max wert",
}


def test_tokenize(spark):
    got = spark.createDataFrame([(k,) for k in TOKENS], "t string").select("t", F.array_join(tokenize(F.col("t")), " ").alias("x")).collect()
    assert {r.t: r.x for r in got} == TOKENS


def test_null_text(spark):
    assert evaluate(spark, None, tokenize, char_trigrams) == [None, None]


def test_trigrams(spark):
    assert evaluate(spark, "ABcd", char_trigrams)[0] == ["abc", "bcd"]
    assert evaluate(spark, "ab", char_trigrams, grapheme_trigrams) == [[], []]
    assert evaluate(spark, "aB_c", canonical_trigrams)[0] == ["a b", " b ", "b c"]
    assert evaluate(spark, "éab", grapheme_trigrams)[0] == ["éab"]


@pytest.mark.parametrize(("a", "b", "want"), [("fetchRw", "fetch_row", 10 / 13), ("colour pickr", "color-picker", 0.6), ("abc", "xyz", 0.0), ("ab", "abcd", 0.0), ("same_name", "sameName", 1.0)])
def test_dice(spark, a, b, want):
    assert spark.range(1).select(dice(F.lit(a), F.lit(b))).first()[0] == pytest.approx(want, abs=1e-9)


def test_trigrams_are_windows_of_clusters(spark):
    import regex
    from pyspark.sql import functions as F

    from quillrank.functions.text import char_trigrams

    texts = ["", "ab", "abcd", "Cafés", "ééé", "한ab", "a\r\nbc", "naïve", "ab\U0001f468‍\U0001f469‍\U0001f467c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", char_trigrams(F.col("t")).alias("g")).collect()
    for r in rows:
        parts = regex.findall(r"\X", r.t.lower())
        assert r.g == ["".join(parts[k : k + 3]) for k in range(len(parts) - 2)]


def test_cosine_rounds_as_in_double_precision(spark):
    from quillrank.functions.similarity import cosine

    a, b = [-0.41, -0.59, 0.3, -0.68], [-0.86, 0.35, -0.34, -1.27]  # 0.545549989 in single steps, 0.545550023 in double ones
    row = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert row.select(F.round(cosine(F.col("a"), F.col("b")), 4)).first()[0] == 0.5456
