import pytest


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes tables as parquet and gives their folder. Rows follow a DDL schema."""

    def write(**given):
        for name, (schema, rows) in given.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
