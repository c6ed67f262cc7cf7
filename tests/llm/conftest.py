import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    rows = [
        (None, "a text without an id, which is long enough to hold a window of fifty bytes", "en", None, 1),
        (1, None, None, "s", None),
        (2, "", "en", "s", 0),
        (3, "  \n\t ", "en", "s", 5),
        (4, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 62),
        (5, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 62),
        (5, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 62),
        (6, long, "xx", "s", len(long)),
        (7, long + " tail", "xx", "s", 0),
        (8, "é漢😀 don't <|endoftext|> MIT License, GNU General Public License", "fr", None, 0),
        (9, "x", "en", "s", 1),
        (-3, "\x00\x01 ÀB ß", "de", "s", 1),
    ]
    rows = [(*r, True, 0, 1.5, "z", "q") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_bytes int, score double, chunk string, component string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
