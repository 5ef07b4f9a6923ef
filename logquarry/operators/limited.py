"""Work that is given up after a time: a search whose regex may run without end."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from logquarry.operators.filters import matcher
from logquarry.staging import settled

#: Seconds that a regex search may take.
SEARCH_SECONDS = 2.0


def within(spark: SparkSession, seconds: float, work: Callable[[], object]) -> object:
    """What ``work`` gives; its jobs are cancelled, and TimeoutError raised, if it takes longer than ``seconds``."""
    tag = f"limited-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late.is_set() and (isinstance(e, PySparkException) or "cancelled" in str(e)):
            raise TimeoutError(f"stopped after {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def regex_search(df: DataFrame, query: str, case_sensitive: bool = False, seconds: float = SEARCH_SECONDS) -> DataFrame:
    """(file_id, number) of the lines that a regex matches, found within a time limit and written as a table."""
    hits = df.where(matcher(query, regex=True, case_sensitive=case_sensitive)).select("file_id", "number")
    return within(df.sparkSession, seconds, lambda: settled(hits, "hits"))
