"""Line dedup over content-defined chunks of lines.

A document's lines are hashed, a hash rolls over the last lines, and a chunk ends
where the rolling hash hits a fixed pattern, so an insertion moves boundaries
near it only. One chunking finds a repeated passage only if two of its boundaries
fall inside it, so a document can be cut by several chunkings with salts of their
own, and what any of them finds goes. Chunks of two lines or more that occur more
than once in the corpus are candidates; as many of a document's as cover the
lines of all are compared byte by byte with their first occurrence, and only
equal ones go. The first occurrence (smallest id, then place) stays, so of equal
lines the first always does.

Only hashes are shuffled for all chunks; bytes travel for the candidates.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemetrics.llm.common import NULL_ID, keyed, materialise, mix64, public_id, spare_names

ROLL_LINES = 2
LEAST_LINES = 2
#: One line in so many ends a chunk.
END_EVERY = 3

_ODD = np.uint64(0x9E3779B97F4A7C15)


#: Chunkings that op6_line_dedup takes the union of, and their END_EVERY.
CHUNKINGS = 32
UNION_EVERY = 2


def chunk_spans(lines: list[bytes], roll: int, least: int, every: int, chunkings: int) -> list[list[tuple[int, int]]]:
    """(first line, number of lines) of the chunks of each chunking; the first is not salted.

    A salted one may end its first chunk below `least`, as a passage may start on the second line.
    """
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, len(lines))
    salts = np.arange(1, chunkings, dtype=np.uint64)[:, None] * _ODD
    salted = np.concatenate([hashes[None, :], mix64(hashes[None, :] ^ salts)])
    rolled = salted.copy()
    for back in range(1, roll):
        rolled[:, back:] += salted[:, :-back] * _ODD ** np.uint64(back)
    hits = (rolled >> np.uint64(33)) % np.uint64(every) == 0
    spans = []
    for salt, row in enumerate(hits):
        own, start = [], 0
        for end in np.flatnonzero(row).tolist():
            if end + 1 - start >= least or (salt and not start):
                own.append((start, end + 1 - start))
                start = end + 1
        if start < len(lines):
            own.append((start, len(lines) - start))
        spans.append(own)
    return spans


def line_chunks(text: str, roll: int = ROLL_LINES, least: int = LEAST_LINES, every: int = END_EVERY):
    """(first line, number of lines, text) of each chunk; joined by line feeds they are the text."""
    lines = text.split("\n")
    (spans,) = chunk_spans([line.encode() for line in lines], roll, least, every, 1)
    return [(first, count, "\n".join(lines[first : first + count])) for first, count in spans]


def _list_chunks(least: int, every: int, chunkings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_hash", "first_line", "n_lines", "hash"]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, row_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_hash", "text"))):
                lines = text.encode().split(b"\n")
                if len(lines) < least:
                    continue
                found = {s for own in chunk_spans(lines, ROLL_LINES, least, every, chunkings) for s in own}
                for first, count in found:
                    if count >= least:
                        chunk = b"\n".join(lines[first : first + count])
                        row = (doc_id, row_hash, first, count, xxhash.xxh3_128_digest(chunk))
                        for column, value in zip(out, row):
                            column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def cover(spans: list[dict]) -> list[dict]:
    """Few of `spans` that hold every line that any of them holds."""
    chosen, upto, best = [], 0, None
    for span in sorted(spans, key=lambda s: s["first_line"]):
        if best and span["first_line"] > upto:
            chosen.append(best)
            upto, best = best["first_line"] + best["n_lines"], None
        if span["first_line"] > upto:
            upto = span["first_line"]
        end = span["first_line"] + span["n_lines"]
        if end > upto and (not best or end > best["first_line"] + best["n_lines"]):
            best = span
    return [*chosen, best] if best else chosen


def _cover_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for row in batch.to_pylist():
            for w in cover(row["spans"]):
                found = (row["doc_id"], row["row_hash"], w["first_line"], w["n_lines"], w["hash"])
                for column, value in zip(out, found):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "row_hash", "first_line", "n_lines", "hash"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted chunk of a document."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for row in batch.to_pylist():
            lines = row["text"].split("\n")
            for w in row["wanted"]:
                first, count = w["first_line"], w["n_lines"]
                body = "\n".join(lines[first : first + count]).encode()
                for column, value in zip(out, (row["doc_id"], row["row_hash"], first, count, w["hash"], body)):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["doc_id", "row_hash", "first_line", "n_lines", "hash", "body"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n_lines, removed, spans, digests = [], [], [], [], []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            lines = text.split("\n")
            keep = np.ones(len(lines), bool)
            for cut in cuts or []:
                keep[cut["first_line"] : cut["first_line"] + cut["n_lines"]] = False
            left = "\n".join([line for line, k in zip(lines, keep) if k])
            texts.append(left)
            n_lines.append(len(lines))
            removed.append(int((~keep).sum()))
            spans.append(len(cuts or []))
            digests.append(hashlib.sha256(left.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row_hash"),
                pa.array(n_lines, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()),
                pa.array(texts, pa.string()),
                pa.array(digests, pa.string()),
            ],
            ["doc_id", "row_hash", "n_lines", "n_removed", "n_chunks_removed", "kept_text", "kept_sha256"],
        )


def _kept_texts(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    def one(text: str, cut: str) -> str:
        lines = text.split("\n")
        gone = {c["first_line"] + i for c in json.loads(cut) for i in range(c["n_lines"])}
        return "\n".join([line for i, line in enumerate(lines) if i not in gone])

    return pd.Series([one(t, c) if c else t for t, c in zip(texts, cuts)], dtype=object)


def repeated_chunks(
    rows: DataFrame, least: int = LEAST_LINES, every: int = END_EVERY, chunkings: int = 1
) -> DataFrame:
    """doc_id, row_hash, first_line, n_lines of chunks that have an earlier equal one.

    Of overlapping chunks so many as hold the lines of all.
    """
    schema = "doc_id long, row_hash long, first_line long, n_lines long, hash binary"
    place = F.struct("doc_id", "row_hash", "first_line", "n_lines")
    # Most chunks occur once: they are listed twice, and two numbers of each counted first.
    listed = rows.mapInArrow(_list_chunks(least, every, chunkings), schema).withColumn("short", F.xxhash64("hash"))
    often = (
        listed.select("short", F.xxhash64(place).alias("at"))
        .groupBy("short")
        .agg(F.min("at").alias("low"), F.max("at").alias("high"))
        .filter("low < high")
        .select("short")
    )
    chunks = materialise(listed.join(often, "short", "left_semi").drop("short").distinct(), "line-chunks")
    firsts = (
        chunks.groupBy("hash")
        .agg(F.min(place).alias("first"), F.count("*").alias("times"))
        .filter("times > 1")
        .drop("times")
    )
    covers = materialise(
        chunks.join(firsts, "hash")
        .filter(place != F.col("first"))
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_list(F.struct("first_line", "n_lines", "hash")).alias("spans"))
        .mapInArrow(_cover_repeats, schema),
        "line-covers",
    )
    originals = covers.select("hash").distinct().join(firsts, "hash").select("first.*", "hash")
    wanted = (
        covers.unionByName(originals)
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_list(F.struct("first_line", "n_lines", "hash")).alias("wanted"))
    )
    bodies = materialise(
        rows.dropDuplicates(["doc_id", "row_hash"])
        .join(wanted, ["doc_id", "row_hash"])
        .mapInArrow(_cut_bytes, schema + ", body binary"),
        "line-bodies",
    )
    first_bodies = bodies.join(firsts, "hash").filter(place == F.col("first")).select(
        "hash", F.col("body").alias("first_body"), "first"
    )
    return (
        bodies.join(first_bodies, "hash")
        .filter((F.col("body") == F.col("first_body")) & (place != F.col("first")))
        .select("doc_id", "row_hash", "first_line", "n_lines")
    )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_LINES,
    every: int = END_EVERY,
    chunkings: int = 1,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_removed, n_chunks_removed, kept_text, kept_sha256.

    Lines end at line feeds; kept lines are joined by line feeds. NULL and empty
    texts are one empty line. A chunk of one line never goes. Rows that share an
    id but not a text count as documents in the order of a hash of their texts;
    a row repeated whole is one document, and each repetition gets its result.
    A NULL id is below all others. With several chunkings what any of them finds
    goes; n_chunks_removed counts chunks that hold all lines removed.
    """
    rows = keyed(docs, id_col, text_col)
    cuts = (
        repeated_chunks(rows, least, every, chunkings)
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_list(F.struct("first_line", "n_lines")).alias("cuts"))
    )
    schema = (
        "doc_id long, row_hash long, n_lines long, n_removed long, n_chunks_removed long, "
        "kept_text string, kept_sha256 string"
    )
    done = rows.join(cuts, ["doc_id", "row_hash"], "left").mapInArrow(_cut_out, schema)
    return done.withColumn("doc_id", public_id()).drop("row_hash")


def deduped_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """`docs` with repeated chunks of lines cut from the text; other columns as they are.

    Documents of which nothing is left have an empty text; NULL texts stay NULL.
    """
    cut_id, cut_hash, cuts = spare_names(docs, "cut_id", "cut_hash", "cuts")
    found = (
        repeated_chunks(keyed(docs, id_col, text_col), **options)
        .groupBy(F.col("doc_id").alias(cut_id), F.col("row_hash").alias(cut_hash))
        .agg(F.collect_list(F.struct("first_line", "n_lines")).alias(cuts))
    )
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == F.col(cut_id)) & (
        F.xxhash64(text) == F.col(cut_hash)
    )
    joined = docs.join(found, same, "left")
    kept = F.when(F.col(cuts).isNull(), docs[text_col]).otherwise(
        F.pandas_udf(_kept_texts, "string")(docs[text_col], F.to_json(cuts))
    )
    return joined.select(*[kept.alias(c) if c == text_col else docs[c] for c in docs.columns])
