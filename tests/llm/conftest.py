import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunks and shards of a few kilobytes, so that small tables have many of both."""
    from inductra.llm import chunks

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(chunks, "SHARD_BYTES", 3_000)


@pytest.fixture(scope="session")
def texts(spark):
    """Makes a table of documents from (id, text) pairs, over several partitions."""

    def make(rows, parts=3):
        return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)

    return make


@pytest.fixture(scope="session")
def clashing():
    """Adds columns called like those that operators make."""

    def add(df):
        names = ("n_tokens", "hits", "encoded", "ids", "shard", "chunk", "slot", "class", "score", "token", "root")
        return df.withColumns({name: F.lit("kept") for name in names})

    return add
