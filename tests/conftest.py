import os
import sys

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(__file__)), os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

import pytest
from pyspark.sql import functions as F

from mailsieve.session import local_session
from mailsieve.sources.messages import conform


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


_ROW = {
    "id": "msg-1",
    "uid": 1,
    "thread_id": "thread-1",
    "subject": "Test subject",
    "sender": "sender@example.com",
    "date": "2026-01-15T10:00:00Z",
    "snippet": "Test snippet",
    "body": "Test body",
    "html_body": None,
    "labels": ["INBOX"],
    "is_unread": False,
}


@pytest.fixture
def messages(spark):
    """Messages from dicts; what a dict leaves out takes the usual test value."""

    def make(*rows):
        filled = [_ROW | {"id": f"msg-{i}", "uid": i} | r for i, r in enumerate(rows, 1)]
        schema = "id string, uid long, thread_id string, subject string, sender string, date string, snippet string, body string, html_body string, labels array<string>, is_unread boolean"
        df = spark.createDataFrame([tuple(r[c] for c in _ROW) for r in filled], schema)
        person = F.struct(F.lit("Sender").alias("name"), F.col("sender").alias("email"))
        to = F.array(F.struct(F.lit("Recipient").alias("name"), F.lit("recipient@example.com").alias("email")))
        return conform(df.withColumn("from", person).withColumn("to", to).drop("sender"))

    return make


@pytest.fixture
def column(spark):
    """Values of one text-to-anything column function."""

    def run(function, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r[0] for r in df.repartition(1).orderBy("i").select(function(F.col("v"))).collect()]

    return run
