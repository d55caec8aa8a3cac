"""Results worked out once and kept in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in the folder of spark.checkpoint.dir; later steps read it, not its plan, which would
    be copied into each of them with its UDFs. Where a local session lacks the setting a temporary folder is set; a
    cluster without it is refused, as each machine would write to its own disk."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="folio-"))
    return df.checkpoint()
