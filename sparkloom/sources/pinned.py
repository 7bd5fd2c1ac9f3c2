"""Frames whose partitions are told once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pinned(df: DataFrame) -> DataFrame:
    """df with the partitions that it has now, in all plans over it; nothing is run or written.

    How a file is cut into parts is told anew for each plan, by the settings and by the cores that executors have just
    then. If an executor is lost or comes late, two plans over one file can differ.
    """
    session = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), session)
