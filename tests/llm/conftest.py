import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoint_folder(spark, tmp_path_factory):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Make a table with the columns of ``documents`` from (doc_id, text[, lang[, source]])."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


WORDS = "the river ran past old mills and quiet farms while children counted boats from a stone bridge under grey evening clouds".split()


def prose(n: int, start: int = 0) -> str:
    """``n`` words, another order for every ``start``."""
    return " ".join(WORDS[(start * 7 + i * (1 + start % 5) + i // len(WORDS)) % len(WORDS)] + (str(i % 13) if (i + start) % 4 == 0 else "") for i in range(n))


@pytest.fixture(scope="session")
def awkward(spark, documents):
    """Null in every column, empty, blank, very long, repeated rows, equal texts, clashing extra columns."""
    long_text = prose(30_000, 3)
    rows = documents(
        (1, prose(40, 1)), (1, prose(40, 1)), (2, prose(40, 1)), (3, None), (4, ""), (5, "   \n\t "), (6, long_text), (None, prose(30, 2)), (7, "word"), (8, "12 345"),
        (9, prose(25, 4), None, None), (10, "héllo wörld ñandú 漢字 😀 " * 3, "fr", "é"),
    )
    extra = ["row", "hash", "kind", "spans", "_key", "_id", "_hash", "_text", "shard", "node", "size", "slot", "target", "item_id", "seed", "doc", "id", "code", "class", "found",
             "words", "laps", "_laps", "html", "url", "host", "path", "level", "all"]
    from pyspark.sql import functions as F

    return rows.select("*", *[F.lit(f"x{i}").alias(name) for i, name in enumerate(extra)])
