import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def ship(spark):
    from longdoc.session import ship_package
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def documents():
    """The smallest documents table as (doc_id, text) rows."""
    import duckdb

    from tests.conftest import SF_SMALL
    return duckdb.execute(f"select doc_id, text from read_parquet('{SF_SMALL}/documents.parquet') order by 1").fetchall()


def edge_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977} other{i % 13}" for i in range(40_000))
    same = " ".join(f"w{i}" for i in range(40))
    return [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, None, "en", "a", 1),
        (4, "", None, None, None), (5, "   \t\n", "en", "a", 1), (6, long_text, "en", "a", 1), (7, "one", "en", "a", 1),
        (8, "12345 67 !!", "de", "a", 1), (None, same, "en", "a", 1), (9, "x" * 70_000, "fr", "a", 1),
        (10, same + " tail", "en", "a", 1), (11, "日本語 テキスト 😀", None, "a", 1), (10, "another text of ten", "en", "a", 1),
    ]
