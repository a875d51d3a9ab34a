import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """A documents table from (doc_id, text) pairs, read from Parquet as a user's would be."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))

    def build(rows, extra=""):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", *([extra] if extra else []))

    return build


@pytest.fixture(scope="session")
def sf_texts(spark, sf):
    """(doc_id, text) of the smallest given documents table."""
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
