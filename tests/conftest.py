import pytest

from logstrata.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "local[4]", "tests", spark_sql_shuffle_partitions="4", spark_ui_showConsoleProgress="false",
        spark_driver_memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def lines_frame(spark, texts, session="s", path="var/log/app.log"):
    rows = [(session, path, i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "session_id string, path string, line_no bigint, content string")
