import random

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import analyze as A
from lexigrove.functions import text as X

CASES = [
    ("<p>good <b>day</b></p>", "good day"),
    ("<p>a</p><p>b</p>", "ab"),
    ("<script>x=1</script>", "x 1"),
    ("1 < 2 and <3", "1 2 and"),
    ('<a title="x > y">z</a>', "z"),
    ("a<!-- gone <b> -->b", "ab"),
    ("t&eacute;l&#233;&#xC9; &lt;b&gt; &amp;lt;", "telee b lt"),
    ("&foo; &copy; &amp", "foo amp"),
    ("caf&#0000000233; &#x00000E9; &#000000000000000000065;", "cafe e a"),
    ("&#0; &#00; &#99999999; &#x1000000; &#xD800;", "0 00 99999999 x1000000 xd800"),
    ("&euro;uros", "uros"),
    ("Čapek Žižka ÆØß ﬃ İı", "apek ziz ka aeoss ffi ii".replace("ziz ka", "zizka")),
    ("étè", "ete"),
    ("  A--B\t9 ", "a b 9"),
    ("日本 x", "x"),
    ("", ""),
]


def test_normalize_table(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(CASES)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", X.normalize(F.col("x")).alias("y")).collect()}
    for i, (x, want) in enumerate(CASES):
        assert got[i] == want == A.normalize(x), (x, got[i], A.normalize(x))


def test_columns_agree_with_strings(spark):
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<", ">", "&eacute;", "&amp;", "&#233;", "&#x41;", "&bogus;", "&", ";", "é", "ß", "Œ", "A", "b", "7", " ", "\n", "-", "́", "€", '"', "'", "<!--", "-->"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", "x", X.normalize(F.col("x")).alias("n"), X.tokenize(F.col("x")).alias("t"), X.normalize_strict(F.col("x")).alias("s"))
    for r in df.collect():
        assert r.n == A.normalize(r.x), repr(r.x)
        assert r.t == A.tokenize(r.x), repr(r.x)
        assert r.s == A.normalize(r.x, True), repr(r.x)


@pytest.mark.parametrize(("word", "want"), [("lait", ["#la", "lai", "ait", "it#"]), ("en", ["#en", "en#"]), ("a", ["#a#"]), ("aa aa", ["#aa", "aa#"]), ("", []), (None, [])])
def test_trigrams(spark, word, want):
    got = spark.createDataFrame([(word,)], "x string").select(X.tokenize(F.col("x"))).first()[0]
    assert got == want == A.tokenize(word)


def test_ordinals(spark):
    rows = [("aaa", 0), ("aab", 1), ("###", 37**3 - 1), ("a!c", None), ("ab", None), ("abcd", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want int").select("want", X.ordinal(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
