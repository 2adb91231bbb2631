"""Mixing sources to target weights by pivotal dependent rounding.

Every document is due target / source size copies. The whole part is given at
once; the fractions are settled in pairs: a random amount of words moves from
one document of the pair to the other, which way drawn so that neither gains on
average, until one of the two is whole. The pair's other one goes on. Words moved
are words gained, so a source's total stays as it was but for its last document.

Long documents are settled first and the shorter ones make good what the last
long one left over. Documents of a source fall into buckets of about `fan_in`, each settles its own
and passes one residual up; buckets combine `fan_in` at a time until one is
left. DataFrame functions only; draws are hashes of the pair, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridemetrics.llm.common import NULL_ID, materialise, numbered_rows, public_id, spare_names

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
FAN_IN = 64
#: Bounds between the classes of length, times the mean length of a source.
LENGTH_CLASSES = (1.5, 0.4)
#: Rows that one step of writing out repeated rows makes.
REPEAT_BLOCK = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    items: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES
) -> DataFrame:
    """source, source_size, source_rows, target of each source of items (source, size).

    Shares go by weight; a source that would pass `most` times its size stops
    there. Sources stop in the order of most * size / weight, so one look at
    running sums in that order tells which do. One row per source is ordered in
    one task, which spills.
    """
    sizes = items.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(most))
    ranked = sizes.withColumn("weight", weight).withColumn("limit", limit)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source that its level does not fill sets the level of all after it.
    tried = ranked.withColumn("level", level)
    held = tried.withColumn("held", F.col("level") * F.col("weight") >= F.col("limit"))
    open_level = F.min(F.when(~F.col("held"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(whole)["level"]
    return held.withColumn("open_level", open_level).select(
        "source",
        "source_size",
        "source_rows",
        F.when(F.col("held"), F.col("limit"))
        .otherwise(F.col("open_level") * F.col("weight"))
        .alias("target"),
    )


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on equal sources, NULL equal to NULL."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.expr("source <=> _source"), how).drop("_source")


def _draw(a: Column, b: Column, seed: int) -> Column:
    """Uniform in [0, 1), the same for the same pair."""
    bits = F.xxhash64(F.lit(seed), a["doc_id"], a["size"], b["doc_id"], b["size"])
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))


def _settle(state: Column, item: Column, seed: int) -> Column:
    """One pair: the residual of `state` and `item`; chosen documents are noted."""
    held = state["held"]
    p, q = held["p"], item["p"]
    ratio = held["size"].cast("double") / item["size"].cast("double")
    up = F.least(1 - p, q / ratio)  # the held one may gain so much, the item giving it
    down = F.least(p, (1 - q) / ratio)
    gains = _draw(held, item, seed) * (up + down) < down
    held_first = F.when(gains, 1 - p <= q / ratio).otherwise(p <= (1 - q) / ratio)

    def other(value: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))

    def with_p(of: Column, value: Column) -> Column:
        return F.struct(of["size"].alias("size"), of["doc_id"].alias("doc_id"), other(value).alias("p"))

    left = F.when(
        held_first, with_p(item, F.when(gains, q - (1 - p) * ratio).otherwise(q + p * ratio))
    ).otherwise(with_p(held, F.when(gains, p + q / ratio).otherwise(p - (1 - q) / ratio)))
    # Whole now: the held one at 1 if it gained, the item at 1 if it did not.
    whole = F.when(held_first, held).otherwise(item)
    taken = F.when(held_first, gains).otherwise(~gains)
    chosen = F.when(taken, F.concat(state["chosen"], F.array(_name(whole)))).otherwise(state["chosen"])
    return F.struct(left.alias("held"), chosen.alias("chosen"))


def _name(item: Column) -> Column:
    return F.struct(item["size"].alias("size"), item["doc_id"].alias("doc_id"))


def _round_buckets(items: DataFrame, seed: int) -> DataFrame:
    """source, bucket, held, chosen of items (source, bucket, size, doc_id, p)."""
    # Long documents first, so that the residual is a short one.
    rows = F.array_sort(
        F.collect_list(F.struct("size", "doc_id", "p")),
        lambda a, b: F.when(a["size"] != b["size"], F.when(a["size"] > b["size"], -1).otherwise(1))
        .when(a["doc_id"] < b["doc_id"], -1)
        .when(a["doc_id"] > b["doc_id"], 1)
        .otherwise(0),
    )
    empty = F.array().cast("array<struct<size:bigint,doc_id:bigint>>")
    return (
        items.groupBy("source", "bucket")
        .agg(rows.alias("rows"))
        .select(
            "source",
            "bucket",
            F.aggregate(
                F.slice("rows", 2, 1 << 30),
                F.struct(F.col("rows")[0].alias("held"), empty.alias("chosen")),
                lambda state, item: _settle(state, item, seed),
            ).alias("state"),
        )
        .select("source", "bucket", "state.held", "state.chosen")
    )


def _tree(level: DataFrame, most: int, fan_in: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The chosen (source, size, doc_id), and what each source has over its due.

    `level` has (source, open, size, doc_id, p), `most` is the largest `open`.
    """
    width = -(-most // fan_in)
    buckets = F.ceil(F.col("open") / F.lit(fan_in)).cast("long")
    level = level.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), buckets))
    chosen = []
    while True:
        rounded = materialise(_round_buckets(level, seed), "mix-level")
        chosen.append(rounded.select("source", F.explode("chosen").alias("one")).select("source", "one.*"))
        held = rounded.select("source", "bucket", "held.*")
        if width <= 1:
            break
        level = held.withColumn("bucket", F.floor(F.col("bucket") / F.lit(fan_in)))
        width = -(-width // fan_in)
    lot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 11)
    taken = lot.cast("double") / F.lit(float(1 << 53)) < F.col("p")
    chosen.append(held.filter(taken).select("source", "size", "doc_id"))
    over = held.select("source", (F.col("size") * (taken.cast("double") - F.col("p"))).alias("over"))
    return reduce(DataFrame.unionAll, chosen), over


def _settled(shares: DataFrame, fan_in: int, seed: int) -> list[DataFrame]:
    """The documents that get one more copy, class of length by class.

    The last document of a class is settled by lot. What its source then has
    over or under its due, the shorter documents make good: each p moves by
    c * p * (1 - p), which stays in [0, 1] and is nothing on average.
    """
    mean = F.col("source_size") / F.col("source_rows")
    rank = reduce(lambda n, t: n + (F.col("size") <= mean * t).cast("int"), LENGTH_CLASSES, F.lit(0))
    left = shares.filter((F.col("p") > 0) & (F.col("size") > 0)).select(
        "source", rank.alias("rank"), "size", "doc_id", "p"
    )
    counts = left.groupBy("source", "rank").agg(F.count("*").alias("open"))
    most = {r["rank"]: r["most"] for r in counts.groupBy("rank").agg(F.max("open").alias("most")).collect()}
    chosen = []
    for k in sorted(most):
        of_class = counts.filter(F.col("rank") == k).drop("rank")
        level = _by_source(left.filter(F.col("rank") == k), of_class)
        won, over = _tree(level, most[k], fan_in, seed)
        chosen.append(won)
        if k == max(most):
            break
        left = left.filter(F.col("rank") > k)
        give = F.col("size") * F.col("p") * (1 - F.col("p"))
        room = left.groupBy("source").agg(F.sum(give).alias("room"))
        c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("over") / F.col("room")))
        share = _by_source(room, over).select("source", c.alias("c"))
        p = F.col("p") + F.coalesce("c", F.lit(0.0)) * F.col("p") * (1 - F.col("p"))
        moved = _by_source(left, share, "left").select("source", "rank", "size", "doc_id", p.alias("p"))
        left = materialise(moved, "mix-left").filter((F.col("p") > 0) & (F.col("p") < 1))
    return chosen


def _settled_rows(
    items: DataFrame, weights: Sequence[float], most_copies: int, fan_in: int, seed: int
) -> DataFrame:
    """One row per (source, doc_id, size) of items: n rows, of which extra + won get whole + 1 copies."""
    targets = source_targets(items, weights, most_copies)
    rows = items.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    joined = _by_source(rows, targets)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("due")
    spare = F.col("n") * (F.col("due") - whole)
    shares = materialise(
        joined.withColumn("due", due)
        .withColumn("whole", whole)
        .withColumn("extra", F.floor(spare))
        .withColumn("p", spare - F.floor(spare)),
        "mix-shares",
    )

    chosen = _settled(shares, fan_in, seed)
    if not chosen:
        return shares.withColumn("won", F.lit(0))
    won = reduce(DataFrame.unionAll, [c.select("source", "doc_id", "size") for c in chosen])
    won = won.toDF("_source", "_doc_id", "_size").withColumn("won", F.lit(1))
    same = F.expr("source <=> _source AND doc_id = _doc_id AND size = _size")
    return (
        shares.join(won, same, "left")
        .withColumn("won", F.coalesce("won", F.lit(0)))
        .drop("_source", "_doc_id", "_size")
    )


def _items(docs: DataFrame, id_col: str, text_col: str, source_col: str, *others: str) -> DataFrame:
    return docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        word_count(docs[text_col].cast("string")).alias("size"),
        *others,
    )


def _copies() -> Column:
    """Copies of the nth of equal rows."""
    one_more = (F.col("nth") <= F.col("extra") + F.col("won")).cast("long")
    return F.when(F.col("size") > 0, F.col("whole") + one_more).otherwise(0)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    fan_in: int = FAN_IN,
    seed: int = 42,
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken, copies.

    Size is the number of words (NULL and empty texts: 0, never taken). Sources
    in the order of their names, NULL last, weigh `weights` in turn and share
    the sum of all sizes; none gets more than `most_copies` times its own. taken
    is copies * size. Documents that share id, size and source count as one
    document with so many copies to spread. An empty table gives no rows.
    """
    items = materialise(_items(docs, id_col, text_col, source_col), "mix-items")
    settled = _settled_rows(items, weights, most_copies, fan_in, seed)
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / REPEAT_BLOCK)))
    in_block = F.sequence(
        F.col("block") * REPEAT_BLOCK + 1, F.least("n", (F.col("block") + 1) * REPEAT_BLOCK)
    )
    return (
        settled.withColumn("block", block)
        .withColumn("nth", F.explode(in_block))
        .withColumn("copies", _copies())
        .select(
            public_id(),
            "size",
            "source_size",
            "target",
            (F.col("copies") * F.col("size")).alias("taken"),
            "copies",
        )
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    fan_in: int = FAN_IN,
    seed: int = 42,
) -> DataFrame:
    """`docs` with each row as often as the mix takes it; the columns stay as they are.

    Rows that share id, size and source are numbered, and each gets its own copies.
    """
    marked, row = numbered_rows(docs, "mix-rows")
    items = materialise(_items(marked, id_col, text_col, source_col, F.col(row).alias("row")), "mix-items")
    settled = _settled_rows(items.drop("row"), weights, most_copies, fan_in, seed)
    # Equal rows are numbered block by block, so that many of them are no one task's.
    key = ["source", "doc_id", "size"]
    blocks = items.withColumn("block", F.floor(F.col("row") / F.lit(REPEAT_BLOCK)))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocks.groupBy(*key, "block")
        .agg(F.count("*").alias("in_block"))
        .withColumn("start", F.coalesce(F.sum("in_block").over(before), F.lit(0)))
    )
    shares = settled.select(*(F.col(c).alias(f"_{c}") for c in key), "whole", "extra", "won")
    same = F.expr("source <=> _source AND doc_id = _doc_id AND size = _size")
    due = starts.join(shares, same).select(
        *(f"_{c}" for c in key), F.col("block").alias("_block"), "start", "whole", "extra", "won"
    )
    within = F.row_number().over(Window.partitionBy(*key, "block").orderBy("row"))
    copies = (
        blocks.withColumn("within", within)
        .join(due, same & (F.col("block") == F.col("_block")))
        .withColumn("nth", F.col("start") + F.col("within"))
        .withColumn("copies", _copies().cast("int"))
        .filter("copies > 0")
    )
    mix_row, mix_copies, nth = spare_names(marked, "mix_row", "mix_copies", "mix_nth")
    copies = copies.select(F.col("row").alias(mix_row), F.col("copies").alias(mix_copies))
    repeated = marked.join(copies, F.col(row) == F.col(mix_row)).withColumn(
        nth, F.explode(F.sequence(F.lit(1), F.col(mix_copies)))
    )
    return repeated.select(*docs.columns)
