import pytest
from pyspark.sql import functions as F

from lodegrid.functions import citations as C
from lodegrid.functions import keys as K
from lodegrid.functions import text as T


def values(spark, items, f):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("x"))).collect()]


def test_doi_rules_differ(spark):
    raw = ["https://doi.org/10.1/A.", " DOI:10.1/a/ ", "doi:https://doi.org/10.1/a", None, "", "http://dx.doi.org/10.1/a"]
    assert values(spark, raw, K.doi_for_dedup) == ["10.1/a.", "10.1/a/", "https://doi.org/10.1/a", None, None, "10.1/a"]
    assert values(spark, raw, K.doi_for_references) == ["10.1/a", "10.1/a/", "https://doi.org/10.1/a", None, None, "http://dx.doi.org/10.1/a"]
    assert values(spark, raw, K.doi_for_enrichment) == ["10.1/a.", "10.1/a", "https://doi.org/10.1/a", "", "", "10.1/a"]
    assert values(spark, raw, K.doi_for_reconciliation) == ["10.1/a.", "10.1/a/", "https://doi.org/10.1/a", "", "", "http://dx.doi.org/10.1/a"]


def test_page_ranges(spark):
    raw = ["45-55", "45–55", "45--55", "12", "art1164:17pp", ":8pp", "e12345", "iii-xxii", "", None, "9-3"]
    assert values(spark, raw, T.page_count) == [11, 11, 11, 1, 17, 8, None, None, None, None, None]


def test_accents_fold_alike(spark):
    raw = ["Éa ñ ß ﬁ ö", "Łódź ǅ ŉ", "Ａｂ", "Ἀθῆναι", None]
    assert values(spark, raw, K.fold_accents) == values(spark, raw, K.fold_accents_fully)


def test_title_and_venue_keys(spark):
    assert values(spark, [" The Élan: a  Test! ", None], K.title_key) == ["the elan a test", ""]
    assert values(spark, ["Proceedings of the The Art, of X"], K.venue_key) == ["art of x"]


def test_passage_keys(spark):
    raw = ["doi:10.1/x:P001", "fallback:ab:P12", "doi:10.1/x", "P001", None]
    assert values(spark, raw, K.passage_owner_doi) == ["doi:10.1/x", None, None, None, None]
    assert values(spark, raw, K.passage_owner_any) == ["doi:10.1/x", "fallback:ab", "doi", None, None]
    assert values(spark, raw, K.passage_is_valid) == [True, False, False, False, False]


def test_names(spark):
    assert values(spark, ["Müller, A.; B", "Anna de Vries", "", None], K.surname_of_list) == ["muller", "vries", "", ""]
    assert values(spark, ["Doe, J. and Roe, R.", "Jane Doe and X"], K.surname_of_bibtex) == ["doe", "doe"]
    assert values(spark, ["hello-foo BAR"], T.capitalised) == ["Hello-Foo Bar"]


def test_cosine(spark):
    pairs = [("A b c", "a B, c!", 1.0), ("a b", "c d", 0.0), ("", "a", 0.0)]
    df = spark.createDataFrame([(k, *p[:2]) for k, p in enumerate(pairs)], "k int, a string, b string").orderBy("k")
    found = [r[0] for r in df.select(T.cosine(T.tokens(F.col("a")), T.tokens(F.col("b")))).collect()]
    assert found == pytest.approx([p[2] for p in pairs])


def test_ngrams_and_chunks(spark):
    assert values(spark, ["a b c d", "a b", None], lambda c: F.size(T.ngrams(T.tokens(c), 3))) == [2, 0, 0]
    assert values(spark, ["x" * 25, "", None], lambda c: F.size(T.chunks(c, 10, 2))) == [3, 0, 0]


def test_reference_keys(spark):
    assert values(spark, ["One two three", "one two", None], lambda c: T.title_year_key(c, F.lit("2020"))) == ["one two three|2020", None, None]
    assert values(spark, ["10.1/a"], lambda c: T.reference_key(c, F.lit("t"), F.lit(""))) == ["doi:10.1/a"]
    assert values(spark, ["", None], lambda c: T.reference_key(c, F.lit(""), F.lit(""))) == [None, None]


CITATIONS = [
    ("[1] Smith, J. Usage in industry. ICSE 2024. https://doi.org/10.1145/3597503.3608128", {"year": "2024", "doi": "10.1145/3597503.3608128"}),
    ("Jones, A., and Liu, B. (2023). Large survey of assistants. Journal of Software.", {"year": "2023", "doi": "", "title": "Large survey of assistants"}),
    ("[1] J. He, and D. Lo, ‘‘LLM-based multi-agent systems for practice,’’ Journal, vol. 10, 2025, doi: 10.1145/3712003", {"year": "2025", "title": "LLM-based multi-agent systems for practice", "authors": "J. He, and D. Lo", "doi": "10.1145/3712003"}),
    ("[11] 2021.PythonWrapperOfSomeTestTool. https://example.org/x.", {"authors": "", "year": "2021", "title": "PythonWrapperOfSomeTestTool"}),
    ("Ahmad, W.U., Chang, K.-W.: Unified pre-training for understanding. (2021)", {"authors": "Ahmad, W. U., Chang, K.-W.", "title": "Unified pre-training for understanding", "year": "2021"}),
    ("Ali, Q.U.A., Horvath, B., 2021. Towards scalable validation of models: a mapping.", {"year": "2021", "title": "Towards scalable validation of models: a mapping"}),
    ("Author, X. 2024. Title is here. In ''IEEE'' conference.", {"title": "Title is here", "year": "2024"}),
    ("Some garbled text with no structure 2022", {"year": "2022", "title": ""}),
]


def test_citations(spark):
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(CITATIONS)], "k int, raw string")
    found = [r["c"].asDict() for r in C.with_citation(df, "raw", "c").orderBy("k").collect()]
    for got, (raw, want) in zip(found, CITATIONS, strict=True):
        assert {k: got[k] for k in want} == want, raw
