import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with clashing extra columns from (doc_id, text) pairs."""

    def make(pairs):
        rows = [(k, t, "en", "s", None) for k, t in pairs]
        return spark.createDataFrame(rows, DOCUMENTS).withColumns({
            "node": F.lit("x"), "bucket": F.lit(1), "key": F.lit("y"), "score": F.lit(None).cast("int"),
            "component": F.lit("z"), "_spread": F.lit(2), "n": F.lit(0)})

    return make


@pytest.fixture(scope="session")
def folder_of(tmp_path_factory):
    """A folder with the given tables as parquet."""

    def make(**tables):
        path = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return str(path)

    return make
