import re

import pytest

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK, ALNUM = "[^\x20\x09-\x0d]+", r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text, pattern=BLANK):
    return re.findall(pattern, (text or "").translate(AZ))


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Write rows (doc_id, text) as documents of a folder, with columns whose names clash with operators' own."""

    def make(rows, extra=True):
        path = str(tmp_path_factory.mktemp("documents"))
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        if extra:
            df = df.selectExpr("doc_id", "text", "'x' AS score", "1 AS kept", "2 AS row_nr", "3 AS digest", "4 AS n", "5 AS cls", "6 AS ids")
        df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
        return spark.read.parquet(f"{path}/documents.parquet")

    return make
