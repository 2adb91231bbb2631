"""The trie of conversation prefixes, by truncation peeling.

A node is a distinct sequence of first turns; its key is a digest chained over
them, so the key of a prefix is met again in every conversation that starts with
it. From the deepest level on, conversations that end at a level are merged with
the nodes that survive from the level below, by key; each node's figures are
complete then, its last turn is stripped, and what is left is grouped anew under
the parent's key. Only counts, sums and smallest ids travel, one row per node.

The end of a conversation that no other shares has nothing to merge with: its
nodes follow from its own turns and it joins the peeling at its parting, so a
round is needed per shared level, however long conversations are. Turns stay
rows all the way; no conversation and no list of members is ever held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridemetrics.llm.common import materialise
from ridemetrics.session import scratch_dir

#: Conversations share the head of the one whose number is a multiple of this.
FAMILY = 20
#: A head is shorter than this.
HEADS = 4
#: Bytes of a key; and ids of an end list that travel as one row.
KEY_BYTES = 16
ENDS_AT_ONCE = 8192

ROOT = bytes(KEY_BYTES)
_WORDS = r"[^\x20\x09-\x0D]+"
_CHAIN = "conv_id long, depth long, key binary, parent binary, words long, before long, last boolean"


def numbered_turns(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, pos (from 1), digest, words of every turn; the texts end here."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spelt = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.sha2(spelt, 256).alias("digest"),
        F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words"),
    ).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return turns.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("pos"),
        F.unhex(F.substring("digest", 1, 2 * KEY_BYTES)).alias("digest"),
        "words",
    )


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns after each conversation's head came from its family's first, and all conv_ids.

    Conversation c gets the first h turns of c - c % family, then its own after
    the first h; h is the CRC-32 of its number in decimal, modulo `heads`.
    """

    def head(conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % heads

    convs = turns.select("conv_id").distinct()
    own = turns.filter(F.col("pos") > head(F.col("conv_id")))
    first = turns.filter((F.col("conv_id") % family == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    wanted = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    lent = wanted.join(first, "base").filter(F.col("pos") <= head(F.col("conv_id")))
    columns = ["conv_id", "pos", "digest", "words"]
    return own.select(*columns).unionByName(lent.select(*columns)), convs


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys along each conversation, its turns in order. `before` counts the words of earlier turns."""
    now, depth, key, before = None, 0, ROOT, 0
    held = None  # the newest turn; whether it is the last shows with the next row

    def table(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", "depth", "key", "parent", "words", "before", "last"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        out = []
        for conv, digest, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "words"))):
            if held:
                out.append((*held, conv != now))
            if conv != now:
                now, depth, key, before = conv, 0, ROOT, 0
            parent = key
            key = hashlib.blake2b(parent + digest, digest_size=KEY_BYTES).digest()
            depth += 1
            held = (conv, depth, key, parent, words, before)
            before += words
        if out:
            yield table(out)
    if held:
        yield table([(*held, True)])


def _end_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, first, ids: sorted members as joined text, some thousand to a row."""
    now, held = None, []

    def row() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([now], pa.binary()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])],
            ["key", "first", "ids"],
        )
        held.clear()
        return out

    for batch in batches:
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (key != now or len(held) >= ENDS_AT_ONCE):
                yield row()
            now = key
            held.append(conv)
    if held:
        yield row()


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 from a key's lists in order."""
    now, sha = None, None

    def rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
            ["key", "ends_sha256"],
        )

    for batch in batches:
        done = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key == now:
                sha.update(b",")
            else:
                if now is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256()
            sha.update(ids.encode())
        if done:
            yield rows(done)
    if now is not None:
        yield rows([(now, sha.hexdigest())])


def end_hashes(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 of (key, conv_id) rows.

    Lists are sorted and spelt wherever their range of (key, conv_id) lies; one
    task per key then only hashes them one after the other, as SHA-256 must.
    """
    order = ["key", "conv_id"]
    lists = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _end_lists, "key binary, first long, ids string"
    )
    return (
        lists.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_end_hashes, "key binary, ends_sha256 string")
    )


def _peel(arrivals: DataFrame, shared: DataFrame) -> DataFrame | None:
    """key, parent, depth and figures of all shared nodes, level by level from the deepest.

    `arrivals` has what joins the peeling at a level: conversations that end
    there, and the tops of ends that nothing shares (`child` 1, under their
    parent's key). `shared` has the attributes of each node below the root.
    """
    spark = arrivals.sparkSession
    path = scratch_dir(spark, "trie-levels")
    deepest = arrivals.agg(F.max("level")).first()[0]
    if deepest is None:
        return None
    survivors = None
    for level in range(deepest, -1, -1):
        met = arrivals.filter(F.col("level") == level).drop("level")
        if survivors is not None:
            stripped = survivors.select(
                F.col("parent").alias("key"), F.lit(1).cast("long").alias("child"), "conv_id", "n_convs", "n_leaves", "saved_tokens"
            )
            met = met.unionByName(stripped)
        nodes = met.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("child").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
        )
        known = shared.filter(F.col("depth") == level).select("key", "parent", "words")
        nodes = nodes.join(known, "key", "left") if level else nodes.withColumns(
            {"parent": F.lit(None).cast("binary"), "words": F.lit(0).cast("long")}
        )
        nodes = nodes.select(
            "key",
            "parent",
            F.lit(level).cast("long").alias("depth"),
            "conv_id",
            "n_convs",
            "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        )
        nodes.write.parquet(f"{path}/level={level}")
        survivors = spark.read.schema(nodes.schema).parquet(f"{path}/level={level}")
    return spark.read.schema(nodes.schema).option("recursiveFileLookup", True).parquet(path)


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    family: int = FAMILY,
    heads: int = HEADS,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by `turn`, NULL first, then by a digest of role and text;
    a NULL role or text is empty. Conversations are rebuilt as `rebuilt` says and
    may have no turn left; they are members of the root. Rows that repeat a turn
    are turns each. Rows without a conversation are left out. A table without a
    conversation gives no rows, not even the root.
    """
    turns = materialise(numbered_turns(conversations, conv_col, turn_col, role_col, text_col), "trie-turns")
    sequences, convs = rebuilt(turns, family, heads)
    chain = materialise(
        sequences.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_chain, _CHAIN), "trie-chain"
    )
    # Conversations of equal turns count as one with their number.
    equal = (
        chain.filter("last")
        .groupBy("key", "depth")
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("times"), F.max(F.col("before") + F.col("words")).alias("total"))
    )
    distinct = materialise(chain.join(equal.select("conv_id", "times", "total"), "conv_id"), "trie-distinct")
    # A key fixes the other columns, so grouping by all is grouping by key.
    shared = materialise(
        distinct.groupBy("key", "parent", "depth", "words").count().filter("count > 1").drop("count"), "trie-shared"
    )
    parting = distinct.join(shared.select("key"), "key", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("parting"))
    placed = materialise(
        distinct.join(parting, "conv_id", "left").withColumn("parting", F.coalesce("parting", F.lit(0).cast("long"))),
        "trie-placed",
    )

    own = placed.filter("depth > parting").withColumn(
        "saved_tokens", (F.col("times") - 1) * (F.col("total") - F.col("before"))
    )
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    arrivals = ["level", "key", "child", "conv_id", "n_convs", "n_leaves", "saved_tokens"]
    tops = own.filter("depth = parting + 1").select(
        F.col("parting").alias("level"),
        F.col("parent").alias("key"),
        one.alias("child"),
        "conv_id",
        F.col("times").alias("n_convs"),
        one.alias("n_leaves"),
        "saved_tokens",
    )
    ended = placed.filter("last AND depth = parting").select(
        F.col("depth").alias("level"),
        "key",
        zero.alias("child"),
        "conv_id",
        F.col("times").alias("n_convs"),
        zero.alias("n_leaves"),
        zero.alias("saved_tokens"),
    )
    turnless = convs.join(chain.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").withColumn("key", F.lit(ROOT))
    empty = turnless.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    empty = empty.withColumns({c: zero for c in ("level", "child", "n_leaves", "saved_tokens")})
    joining = materialise(tops.union(ended).union(empty.select(*arrivals)), "trie-arrivals")

    columns = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    peeled = _peel(joining, shared)
    if peeled is None:
        peeled = conversations.sparkSession.createDataFrame([], columns)
    private = own.select(
        "key",
        "parent",
        "depth",
        "conv_id",
        F.col("times").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        "saved_tokens",
        (F.col("depth") == F.col("parting") + 1).alias("top"),
    )
    # Below its parting a conversation is its own parent; other nodes look theirs up.
    parents = peeled.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    looked_up = peeled.unionByName(private.filter("top").drop("top")).join(parents, "parent", "left")
    inner = private.filter("NOT top").drop("top").withColumn("parent_conv_id", F.col("conv_id"))
    ends = chain.filter("last").select("key", "conv_id").unionByName(turnless.select("key", "conv_id"))
    nodes = looked_up.unionByName(inner).join(end_hashes(ends), "key", "left")
    return nodes.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
