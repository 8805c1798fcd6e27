import pytest
from pyspark.sql import types as T

LONG = "the quick brown fox jumps over the lazy dog, and the lazy dog sleeps. " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and blank texts, a very long one, repeated rows, and
    columns whose names clash with those that operators add."""
    from bookflow.llm.common import prepare
    prepare(spark)
    kind = T.StructType.fromDDL("doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, score string, "
                                "_text string, spans string, fp string, n_entities string, predicted string, lang_pred string")
    rows = [(1, "The cat sat on the mat and looked at the dog.", "en", "s", 45), (1, "The cat sat on the mat and looked at the dog.", "en", "s", 45),
            (2, None, "en", "s", None), (3, "", None, None, 0), (4, " \t\n ", "fr", "s", 4), (5, LONG, "en", "s", len(LONG)),
            (None, "Le chat est assis devant la porte de la maison.", "fr", None, 46), (None, None, None, None, None),
            (6, "12345 67890 !!! ???", "en", "s", 19), (7, "Le chat est assis devant la porte, dit la dame.", "fr", "s", 46),
            (7, "x", "fr", "s", 1), (8, "İstanbul ß \U0001F600 é   　 end", "de", "s", 20)]
    return spark.createDataFrame([(*r, *["c"] * 8) for r in rows], kind)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
