"""A branch's log as a stream of changes: each commit's diff is appended to a folder that Spark streams from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchframe.engine.database import Session

FEED = "object string, from_commit string, to_commit string, kind string, item string"


def append_changes(session: Session, old: str, new: str, folder: str) -> int:
    """Write the row-level changes of all objects between two commits; how many objects changed."""
    n = 0
    for row in session.diff_objects(old, new).toLocalIterator():
        changes = session.diff(old, new, row["path"])
        item = F.to_json(F.struct(*[c for c in changes.columns if c != "kind"]))
        changes.select(
            F.lit(row["path"]).alias("object"), F.lit(session.db.resolve(old)).alias("from_commit"), F.lit(session.db.resolve(new)).alias("to_commit"), F.col("kind"), item.alias("item"),
        ).write.mode("append").parquet(folder)
        n += 1
    return n


def change_stream(session: Session, folder: str) -> DataFrame:
    """A streaming DataFrame over the feed; late files are picked up exactly once by Spark's source log."""
    return session.db.spark.readStream.schema(FEED).parquet(folder)
