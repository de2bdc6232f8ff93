import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from relindex.session import CORE_CONF
    b = (SparkSession.builder.master("local[4]").appName("relindex-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "6g")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="relindex-test-ckpt-")))
    for k, v in CORE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def headers_df(spark, rows):
    """rows: (grp, article_number, message_id, subject, bytes, date)."""
    from relindex.sources.headers import HEADER_SCHEMA
    return spark.createDataFrame(rows, HEADER_SCHEMA)
