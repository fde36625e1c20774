"""Incremental ``propose`` over inventory snapshots that arrive as files.

The original tool is batch-only; this is the same E1 plan run per micro-batch
with Structured Streaming. Each arriving Parquet file holds whole repositories
(every file of a repository in one snapshot), so a micro-batch is a complete
inventory for the repositories it contains. ``foreachBatch`` runs ``propose``
on it and writes the proposals (and the repository types) to tables keyed by
``repo_id`` and ``snapshot`` (the batch id). The stream's progress lives in
``checkpoint_location``, so a restarted or failed query resumes where it
stopped; a batch that is run again overwrites its own snapshot's folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.plans import entrypoints as EP
from treeline.sources.inventory import RAW_FILES_COLUMNS

INVENTORY_DDL = ", ".join(
    [f"{n} {t.simpleString()}" for n, t in RAW_FILES_COLUMNS.items()] + ["content string"])


def propose_stream(spark: SparkSession, inventory_dir: str, output_dir: str,
                   checkpoint_location: str, available_now: bool = True,
                   max_files_per_trigger: int | None = None, with_file_seq: bool = True):
    """Start the stream; returns the ``StreamingQuery``.

    ``with_file_seq=False``: the snapshots have no such column, files stand in the order of
    their paths.
    """
    ddl = INVENTORY_DDL if with_file_seq else INVENTORY_DDL.replace("file_seq bigint, ", "")
    reader = spark.readStream.schema(ddl)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    snapshots = reader.parquet(inventory_dir)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        p = EP.propose(batch, file_backed=True)
        for name, table in (("proposals", p.proposals), ("repo_types", p.types)):
            table.write.mode("overwrite").parquet(f"{output_dir}/{name}/snapshot={batch_id}")

    writer = snapshots.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
