import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rid string, fp string, key string, name string, place string, kept string"
PASSAGE = " ".join(f"wort{i}" for i in range(60))
LINES = "erste zeile hier\nzweite zeile dort\ndritte zeile da"


def row(doc_id, text, lang="de", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * 7)


ROWS = [
    row(1, "Alpha beta gamma delta epsilon zeta"),
    row(2, "alpha  beta\tgamma delta epsilon zeta"),
    row(3, None),
    row(4, ""),
    row(5, " \n\t "),
    row(6, f"vorher {PASSAGE} nachher", "de", "s2"),
    row(7, f"ganz anderes {PASSAGE} ende", "de", "s2"),
    row(8, f"{LINES}\nnur hier eine zeile", "fr", None),
    row(9, f"kopf einer anderen\n{LINES}", "fr", None),
    row(9, f"kopf einer anderen\n{LINES}", "fr", None),
    row(None, "Alpha beta gamma delta epsilon zeta"),
    row(None, None, None, "s3"),
    row(10, "ünïcode straße 12345 !!! 漢字 " * 3, None, "s3"),
    row(11, "wort " * 30000, "de", "s4"),
    row(12, "12 34 !!", "de", "s4"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls anywhere, empty and long texts, ties, repeated rows, clashing columns."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
