import pytest

#: Names that operators use inside or return; here they are columns of the input.
CLASHES = ("size", "taken", "copies", "target", "source_size", "key", "bucket", "keep_id",
           "group_size", "kept", "digest", "shard", "n_shingles", "component_id", "bands", "rep",
           "n", "own", "held_out", "score", "predicted", "lang_pred", "label", "ids", "n_tokens",
           "spans", "n_words", "failed_bits", "_doc_id", "_copies")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + \
    ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source), with clashing extra columns."""
    def make(rows):
        return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(CLASHES)) for r in rows], SCHEMA)
    return make


LONG = " ".join(f"w{i % 4000}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [(1, "one two three four five six", "en", "b"), (1, "one two three four five six", "en", "b"),
            (2, "one  two three\tfour five six", None, "b"), (3, "", "en", "a"), (4, None, "de", "a"),
            (5, LONG, "en", None), (6, LONG + " end", None, None), (None, "lost words here", None, None),
            (None, None, None, None), (7, " \n\t ", "fr", "c"), (8, "Ünïcode ΣΑΣ 漢字 😀 <|endoftext|>", "xx", "c"),
            (9, "z" * 50_000, "en", "c"), (10, "a", "en", "b")]
