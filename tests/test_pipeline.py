import pytest

from lumenfind.operators import stages as S
from lumenfind.plans.pipeline import Pipeline, PipelineTypeError, QueryPipeline

FIELDS = {"text": "String", "number": "u64", "size": "usize"}


@pytest.mark.parametrize(
    "source",
    [
        "text WhitespaceTokenizer > LowercaseFilter",
        "text WhitespaceTokenizer LowercaseFilter",
        "text WhitespaceTokenizer > AlphaNumericTokenizer > LowercaseFilter > Stemmer(English)",
        "text WhitespaceTokenizer > NumberFilter | [number] > LowercaseFilter > StopwordFilter('a', \"b\")",
        "size WhitespaceTokenizer > ToUsize",
        "text WhitespaceTokenizer > Stemmer(Algorithm::English)",
        "text LowercaseFilter",
    ],
)
def test_legal(source):
    Pipeline.parse(source).check(FIELDS)


@pytest.mark.parametrize(
    "source",
    [
        "text WhitespaceTokenizer",
        "text LowercaseFilter > NumberFilter | [number] > Stemmer",
        "text LowercaseFilter > AlphaNumericTokenizer",
        "text WhitespaceTokenizer > Stemmer > LowercaseFilter",
        "text WhitespaceTokenizer > StopwordFilter(a)",
        "text WhitespaceTokenizer > NumberFilter > LowercaseFilter",
        "text WhitespaceTokenizer > NumberFilter | [text] > LowercaseFilter",
        "text WhitespaceTokenizer > LowercaseFilter | [number]",
        "nowhere LowercaseFilter",
        "number WhitespaceTokenizer > LowercaseFilter",
    ],
)
def test_illegal(source):
    with pytest.raises(PipelineTypeError):
        Pipeline.parse(source).check(FIELDS)


@pytest.mark.parametrize("source", ["text NoStage", "text WhitespaceTokenizer > [All in text]", "text Stemmer(", "text ?", ""])
def test_unreadable(source):
    with pytest.raises(SyntaxError):
        Pipeline.parse(source)


def test_query_pipelines():
    q = QueryPipeline.parse("WhitespaceTokenizer > NumberFilter | [Any in number] > LowercaseFilter > [All in text]").check(FIELDS)
    assert q.final == "text" and q.steps[1].branch == "number"
    for source in ("WhitespaceTokenizer > LowercaseFilter", "LowercaseFilter > [All in text] > Stemmer"):
        with pytest.raises(SyntaxError):
            QueryPipeline.parse(source)
    with pytest.raises(ValueError):
        QueryPipeline.parse("LowercaseFilter > [Some in text]")


def test_own_stage(spark):
    from pyspark.sql import functions as F

    @S.register_stage
    class Reverse(S.Stage):
        takes = (S.STR, S.STRING)
        emits = S.STRING

        def transform(self, tokens):
            return tokens.withColumn("token", F.reverse("token"))

    p = Pipeline.parse("text WhitespaceTokenizer > Reverse").check(FIELDS)
    rows = p.apply(spark.createDataFrame([(1, "abc de"), (2, None)], "doc_id long, token string")).collect()
    assert sorted(r.term for r in rows) == ["cba", "ed"]
    del S.STAGES["Reverse"]
