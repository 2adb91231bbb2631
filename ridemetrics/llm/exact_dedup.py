"""Exact dedup by content sort.

Rows are range-partitioned at sampled splitters on the start of their
normalised bytes, a digest of all of them, and the id. Each partition is sorted
(Spark spills to disk), so equal texts lie next to each other, and neighbours
are compared whole. A run of equal neighbours inside a batch is settled there. One
that goes on from batch to batch gives a summary when it ends; only its rows are
joined with it. The id is part of the range key, so a group of copies that fills
many partitions is cut between them: the first and the last run of each partition
carry their text, and equal ones are put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridemetrics.llm.common import NULL_ID, keyed, materialise, public_id

#: Bytes of the text in a splitter; splitters stay small however long texts are.
HEAD_BYTES = 32


_MARKED = "doc_id long, digest binary, leader long, n long, part long, run long, text string"


def _mark_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their run, and a summary row (without a doc_id) for each run longer than a batch shows.

    A row of a run that lies inside its batch has the run's leader (its first id)
    and size. Any other row has the number of its run. So have summaries; those of
    the first and the last run of the task have the text too.
    """
    part = TaskContext.get().partitionId()
    names = [column.split()[0] for column in _MARKED.split(", ")]
    open_run = None  # number, leader, size so far, digest and text of the run that may go on

    def summary(run: tuple, edge: bool) -> pa.RecordBatch:
        number, leader, size, digest, text = run
        row = [None, digest, leader, size, part, number, text if edge else None]
        kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        text, ids = batch.column("text"), batch.column("doc_id").to_numpy()
        new = np.ones(len(ids), bool)
        new[0] = open_run is None or text[0].as_py() != open_run[4]
        if len(ids) > 1:
            new[1:] = pa.compute.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        if open_run is not None and new[0]:
            yield summary(open_run, edge=open_run[0] == 0)
        starts = np.flatnonzero(new)
        first_number = 0 if open_run is None else open_run[0] + 1
        # Runs of this batch; the first of them may have begun before it.
        begins = starts if new[0] else np.r_[0, starts]
        sizes = np.diff(np.r_[begins, len(ids)])
        numbers = np.arange(len(begins)) + first_number - (not new[0])
        settled = np.ones(len(begins), bool)
        settled[-1] = False
        if not new[0] or numbers[0] == 0:
            settled[0] = False
        for k in {0, len(begins) - 1}:
            if settled[k]:
                continue
            goes_on = k == 0 and not new[0]
            at = int(begins[k])
            before = open_run if goes_on else (int(numbers[k]), int(ids[at]), 0, batch.column("digest")[at].as_py(), text[at].as_py())
            run = (*before[:2], before[2] + int(sizes[k]), *before[3:])
            if k == len(begins) - 1:
                open_run = run
            else:
                yield summary(run, edge=run[0] == 0)
        inside = np.repeat(settled, sizes)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("digest"),
                pa.array(np.repeat(ids[begins], sizes), pa.int64(), mask=~inside),
                pa.array(np.repeat(sizes, sizes), pa.int64(), mask=~inside),
                pa.array(np.full(len(ids), part), pa.int64()),
                pa.array(np.repeat(numbers, sizes), pa.int64(), mask=inside),
                pa.nulls(len(ids), pa.string()),
            ],
            names,
        )
    if open_run is not None:
        yield summary(open_run, edge=True)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the largest id stays. NULL texts are
    empty texts and equal each other. A NULL id is smaller than any other; rows
    that repeat the kept id are kept all. `normalise` maps the text column
    before comparison; by default nothing changes. An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col).drop("row_hash")
    if normalise is not None:
        rows = rows.withColumn("text", normalise(F.col("text")))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    head = F.substring(F.encode("text", "UTF-8"), 1, HEAD_BYTES)
    ordered = (
        rows.withColumn("head", head)
        .repartitionByRange("head", "digest", F.desc("doc_id"))
        .sortWithinPartitions("head", "digest", "text", F.desc("doc_id"))
        .select("doc_id", "digest", "text")
    )
    marked = materialise(ordered.mapInArrow(_mark_runs, _MARKED), "exact")
    summaries = marked.filter("doc_id IS NULL").drop("doc_id")
    # Two runs per partition at most; equal texts among them are one group.
    edges = summaries.filter("text IS NOT NULL").select("digest", "text", "part", "run", "leader", "n")
    whole = edges.groupBy("digest", "text").agg(F.max("leader").alias("leader"), F.sum("n").alias("n"))
    joined = edges.select("digest", "text", "part", "run").join(whole, ["digest", "text"])
    runs = summaries.filter("text IS NULL").select("part", "run", "leader", "n").unionByName(
        joined.select("part", "run", "leader", "n")
    )
    settled = marked.filter("doc_id IS NOT NULL AND n IS NOT NULL").select("doc_id", "digest", "leader", "n")
    others = marked.filter("doc_id IS NOT NULL AND n IS NULL").select("doc_id", "digest", "part", "run")
    found = settled.unionByName(others.join(runs, ["part", "run"]).drop("part", "run"))
    return found.select(
        public_id(),
        F.when(F.col("leader") != NULL_ID, F.col("leader")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("doc_id") == F.col("leader")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
