import pytest
from pyspark.sql import types as T

LONG = "wort " * 30000
DOCS = [
    (0, "The cat sat on the mat. The cat sat on the mat.\nThe cat sat.", "en", "a", 1),
    (1, None, None, None, None),
    (2, "", "en", "b", 0),
    (3, "   \n\t ", "en", "a", 6),
    (4, "one", "en", None, 3),
    (5, "The cat sat on the mat. The cat sat on the mat.\nThe cat sat.", "en", "c", 1),
    (6, LONG, "de", "a", len(LONG)),
    (7, "été ÉTÉ naïve Straße 中文 字 e\u0301 \u212a \u00a0x <|endoftext|> don't, it's 3.14!!", "fr", "a", 5),
    (None, "a row without an id", "en", "a", 5),
    (9, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "en", "d", 5),
    (10, "ALPHA beta, gamma delta epsilon; zeta eta theta iota kappa lambda mu nu xi omicron", "en", "d", 5),
    (10, "ALPHA beta, gamma delta epsilon; zeta eta theta iota kappa lambda mu nu xi omicron", "en", "d", 5),
    (11, "\x1c odd\x00bytes \x7f\x85here", "en", "a", 4),
]
BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "CAT"), (3, None), (4, "..."), (5, "cat!")]
PAGES = [
    (1, "http://A.Example.ORG/es/1?x#y", "<html><body><nav><a href=/>menu here</a></nav><article><h1>Title of it</h1><p>First &amp; second  paragraph here.<p>More text follows in this one.</article><footer>bottom line</footer></body></html>"),
    (2, None, None),
    (3, "no scheme", ""),
    (4, "https://x.com/fr/1", "plain text < 3 and no tags"),
    (5, "https://x.com", "<div><p>unclosed <b>bold <script>var a='<p>no</p>'</script><!-- open comment"),
    (6, "https://x.com/de/a#b://c.org/", "<article><p>" + "long text here. " * 20000 + "</p></article>"),
]
TURNS = [
    (0, 1, "user", "A question?"), (0, 2, "assistant", "An answer."), (0, 2, "assistant", "An answer."), (0, 3, None, None), (0, None, "tool", "no turn"),
    (1, 0, "system", "Be kind."), (1, 0, "system", "Be kind."), (1, 5, "user", " \t\n"), (1, 6, "assistant", "broken off "), (1, 7, "", "x"), (1, 8, "user", ""),
    (None, 1, "user", "no conversation"), (None, None, None, None), (2, 3, "user", "word. " * 50000), (3, 1, "assistant", "Ünïcode 字!"), (3, 1, "user", "tie."),
    (4, None, "user", "one."), (4, None, "user", "two."), (5, -3, "user", "minus."), (6, 1, "stranger", "s?"),
]
LABELS = [(0, 1, 0), (4, 0, 0), (6, 1, 1), (9, None, None), (10, 1, 0), (10, 0, 1), (99, 1, 0), (None, 1, 1)]


def tables(spark, path, docs=DOCS, bench=BENCH, pages=PAGES, labels=LABELS, turns=TURNS):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(2).write.parquet(f"{path}/conversations.parquet")
    return str(path)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows and ids, and odd bytes."""
    return tables(spark, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [], [], [], [], [])


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """Documents with further columns that have the names of results."""
    from pyspark.sql import functions as F

    names = "score rule kept n_words spans items target source_size n_copies component_id held_out offending taken size node h c start".split()
    d = spark.read.parquet(f"{odd}/documents.parquet").withColumns({n: F.lit(f"own {n}") for n in names})
    assert isinstance(d.schema["score"].dataType, T.StringType)
    return d
