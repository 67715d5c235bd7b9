import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def hard_docs(spark):
    """Null ids and texts, empty and blank texts, repeated rows, one very long text, and clashing extra columns."""
    long_text = "\n".join(f"line number {i % 900} of the very long text w{i}" for i in range(6000))
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, "   \n\t "),
            (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (5, long_text), (6, long_text),
            (7, "one"), (7, "one"), (8, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa"),
            (9, "日本語 テキスト 😀\n<|endoftext|> it's 12,5.\n\n!!"), (10, "x\x1cy   z")]
    out = [(i, t, "en", 5, "c", "k", 1.0) for i, t in rows]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, kept int, component_id string, bands string, score double")
