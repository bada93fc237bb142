import pytest

#: Clashing extra columns that operators must ignore.
EXTRA = {"class": "x", "bucket": 1, "start": 2, "h": 3, "n": 4, "w": "y", "score": 0.5, "words": "z", "text_hash": 9, "part": 1, "slot": 5}


@pytest.fixture()
def make_docs(spark):
    """A documents table from (doc_id, text) rows, with clashing extra columns on request."""
    from pyspark.sql import functions as F

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
        return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}) if extra else df

    return make
