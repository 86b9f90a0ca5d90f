"""Streams of revisioned requests: only the latest revision of a key is answered, late ones are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATEST = "key string, revision long, payload string, dropped long"


def _keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else -(2**63)
    best, dropped = None, 0
    for rows in batches:
        for r in rows.itertuples():
            if r.revision > seen:
                dropped += best is not None
                best, seen = r, r.revision
            else:
                dropped += 1
    state.update((int(seen),))
    if best is not None:
        yield pd.DataFrame({"key": [key[0]], "revision": [int(best.revision)], "payload": [best.payload], "dropped": [dropped]})


def latest_revisions(requests: DataFrame) -> DataFrame:
    """A stream (key, revision, payload) to one row for each key and trigger in which a newer revision came.

    The state of a key is one number. Rows of an equal or older revision than one seen before are dropped.
    """
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("revision").cast("long").alias("revision"), F.col("payload").cast("string").alias("payload"))
    return rows.groupBy("key").applyInPandasWithState(_keep, LATEST, "seen long", "append", GroupStateTimeout.NoTimeout)


def latest_of_table(requests: DataFrame) -> DataFrame:
    """The same over a finished table: each key's row of the greatest revision."""
    return requests.groupBy("key").agg(F.max("revision").alias("revision"), F.max_by("payload", "revision").alias("payload"))


def staged(batches: DataFrame, path: str, expected: str):
    """A writer for provisional batches: they are staged as they come, and `commit` moves them on if their content hash is the expected one.

    The hash is the SHA-256 of the sorted row hashes, so it doesn't depend on the order of arrival.
    """
    spark = batches.sparkSession
    query = batches.writeStream.format("parquet").option("path", f"{path}/staged").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{path}/staged")
    hashed = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))
    # Sums of the hashes' four words: a bounded value for any number of rows.
    words = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(4)]
    found = hashed.agg(F.count("*").alias("n"), *words).select(F.sha2(F.concat_ws("|", "n", "w0", "w1", "w2", "w3"), 256)).first()[0]
    if expected and found != expected:
        raise ValueError(f"the stream's content hash is {found}")
    return rows, found
