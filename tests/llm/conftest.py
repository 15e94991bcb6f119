import pytest

# Texts with every edge the operators define: null, empty, blank, tied, repeated, very long, odd characters.
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (0, BASE, "en", "a"),
    (1, None, "en", "b"),
    (2, "", None, "a"),
    (3, " \t\n\x0b", "de", None),
    (4, "start " + BASE + " end", "en", "a"),
    (5, "start " + BASE + " end", "en", "a"),
    (5, "start " + BASE + " end", "en", "a"),
    (6, " ".join(f"word{i}" for i in range(20, 50)).upper() + "\n" + BASE[100:], "en", "c"),
    (7, "don't we'll they're <|endoftext|> x\n\nça va? \U0001f600 ½ ²³ 　 tab\tend  ", "fr", "b"),
    (8, "\n".join(["A line that is long enough to be counted as repeated, sure"] * 3 + [f"own line {8} of this very text that nobody else can have"]), "en", "c"),
    *[(9 + i, f"own {i} words here\n  a LINE that is long enough to be counted as repeated, sure\t\nend", "en", "d") for i in range(6)],
    (20, "the of to in and " * 400 + BASE, "en", "a"),
    (21, " ".join(f"x{i % 977}y{i % 13}" for i in range(30_000)), "de", "d"),
    (None, BASE + " tail", "en", "a"),
    (22, "aaaaaaaaaaaa 'sss ''s 's", "en", None),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _doc string, size int, block long, target string"


@pytest.fixture(scope="session")
def documents(spark):
    """A small table with clashing extra columns, over several partitions."""
    rows = [(*x, len(x[1] or ""), "d", 1, 2, "t") for x in TEXTS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def given(spark, sf):
    """The generated documents as a list of (doc_id, text, lang, source)."""
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)
