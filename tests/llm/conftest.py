import pytest

#: Nulls in every column, empty and blank texts, ties, repeated rows, and one very long text.
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
ROWS = [
    (0, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (2, "", "en", None, 0),
    (3, None, None, None, None),
    (4, "  \n\t ", "de", "b", 5),
    (5, LONG, "en", "b", len(LONG)),
    (None, "a row without an id", "en", "c", 19),
    (7, "Größe über ä ö ü ß 日本語 🎉 naïve café", "de", "c", 36),
    (8, "mail me at joe.doe+x@mail.example.com or +1 (555) 123-4567, 10.0.0.255, 4111 1111 1111 1111", "en", "d", 90),
    (9, "one", None, "d", 3),
    (10, "<|endoftext|> and <|startoftext|> inside\x1cs", "en", "d", 40),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case, and extra columns whose names operators use themselves."""
    rows = [(*r, k, "z", [1.0], k) for k, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, rep string, registers array<double>, bucket int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
