import pytest
from pyspark.sql import functions as F

from lumenfind.functions.stemming import porter2
from lumenfind.functions.text import parse_u64
from lumenfind.operators import stages as S


def run(spark, texts, *stages):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, token string").withColumn("pos", F.array().cast("array<int>"))
    for s in stages:
        df = s.transform(df)
    return [(r.doc_id, str(r.token)) for r in df.orderBy("doc_id", "pos").collect()]


def test_tokenizers(spark):
    texts = ["  don't\tstop　now ", "", None, "a--b_c é1", " x"]
    assert run(spark, texts, S.WhitespaceTokenizer()) == [(0, "don't"), (0, "stop"), (0, "now"), (3, "a--b_c"), (3, "é1"), (4, "x")]
    assert run(spark, texts, S.AlphaNumericTokenizer()) == [(0, "don"), (0, "t"), (0, "stop"), (0, "now"), (3, "a"), (3, "b"), (3, "c"), (3, "é1"), (4, "x")]
    assert run(spark, ["a.b c"], S.WhitespaceTokenizer(), S.AlphaNumericTokenizer()) == [(0, "a"), (0, "b"), (0, "c")]


def test_lower_stem_stopwords(spark):
    assert run(spark, ["ÀÉ ΣΑΣ"], S.WhitespaceTokenizer(), S.LowercaseFilter()) == [(0, "àé"), (0, "σας")]
    assert run(spark, ["Running flies RUNNING"], S.WhitespaceTokenizer(), S.Stemmer()) == [(0, "Run"), (0, "fli"), (0, "RUNNING")]
    # The order of the list doesn't matter; case does.
    assert run(spark, ["the The of"], S.WhitespaceTokenizer(), S.StopwordFilter("zz", "the", "aa")) == [(0, "The"), (0, "of")]
    assert run(spark, ["a b"], S.WhitespaceTokenizer(), S.StopwordFilter()) == [(0, "a"), (0, "b")]
    with pytest.raises(ValueError):
        S.Stemmer("Klingon")


NUMBERS = {"7": "7", "+7": "7", "007": "7", "0": "0", "18446744073709551615": "18446744073709551615", "0" * 60 + "9": "9"}
STRINGS = ["18446744073709551616", "-0", "+", "1.0", "٣", "1" * 50, "7a"]


def test_numbers(spark):
    texts = [*NUMBERS, *STRINGS]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_u64(F.col("t")).alias("v")).collect()
    assert {r.t: str(r.v) for r in rows if r.v is not None} == NUMBERS
    df = spark.createDataFrame([(0, t) for t in texts], "doc_id long, token string").withColumn("pos", F.array().cast("array<int>"))
    n, s = S.NumberFilter().branch(df).count(), S.NumberFilter().transform(df).count()
    assert (n, s) == (len(NUMBERS), len(STRINGS))
    assert S.ToUsize().transform(df).count() == len(NUMBERS)


def test_debugger(spark):
    assert run(spark, ["a b"], S.WhitespaceTokenizer(), S.Debugger()) == [(0, "a"), (0, "b")]
    assert run(spark, ["a b"], S.WhitespaceTokenizer(), S.Debugger("seen")) == [(0, "a"), (0, "b")]


@pytest.mark.parametrize(
    "word, stem",
    [line.split() for line in """
    consigned consign|consistently consist|consolation consol|consolingly consol|knackeries knackeri|knavish knavish|knightly knight|knitted knit
    generate generat|generic generic|general general|happy happi|cry cri|by by|say say|hoping hope|hopped hop|relational relat|conditional condit
    skies sky|dying die|news news|proceed proceed|succeed succeed|agreed agre|feed feed|ties tie|cries cri|gas gas|gaps gap|kiwis kiwi
    possibly possibl|electricity electr|sensational sensat|formative format|hopefulness hope|goodness good|controlling control|youth youth
    apology apolog|luxuriously luxuri|adoption adopt|yielding yield|communism communism|arsenal arsenal
    """.replace("\n", "|").split("|") if line.strip()],
)
def test_porter2(word, stem):
    assert porter2(word) == stem
