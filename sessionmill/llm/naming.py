"""Exact duplicates by deterministic block naming.

A text without white space is cut into blocks of ``BLOCK`` bytes. Different blocks, sorted, get integer names; adjacent names of a
document form pairs, different pairs, sorted, get names again, until a document is down to one. That name and the number of
levels are its identity: names stand for different contents by construction, so equal identities are equal texts, whatever any hash does.

Layout: DataFrame operations only. The text is shuffled once, to tell different blocks apart, and copies are merged before that shuffle. A
name goes back to its places by the block's 64-bit hash, where the sorted blocks show that only one has it, and else (the blocks
of ``shared`` hashes) by the block itself. Places of a frequent block are many rows of one join key, which adaptive execution splits, both sides
being plain shuffles; levels halve the rows and are written tables. The rounds are as many as the logarithm of the longest text's blocks.

Defined results: a null text is an empty one, and empty texts are equal; of equal rows with the same id one stays, the others
are copies of it; a row without an id stays only if no equal row of that length has one; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.frames import Steps

BLOCK = 4096
SPACES = " \t\n\x0b\f\r"
NO_PARTNER = -1


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, "")


def _hash(block: Column) -> Column:
    return F.xxhash64(block)


def blocks(docs: DataFrame, steps: Steps, size: int = BLOCK, hashed=_hash) -> DataFrame:
    """(row, doc_id, n_chars, text_sha256, count, pos, block, h): a row per block, with ``row`` the document's number in this run."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_chars"), normalised(F.col("text")).cast("binary").alias("bytes"),
    )
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / size)).cast("int")
    rows = rows.withColumn("text_sha256", F.sha2("bytes", 256)).withColumn("count", count)
    pieces = F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))
    cut = rows.select("row", "doc_id", "n_chars", "text_sha256", "count", F.posexplode(pieces).alias("pos", "block"))
    return steps.keep(cut.withColumn("h", hashed(F.col("block"))), "blocks")


def _sorted_names(different: DataFrame, by: list[str], steps: Steps, name: str) -> DataFrame:
    """``different`` rows with ``name``, an integer: their place in the order of ``by`` within a partition, after the partition's number."""
    return steps.keep(different.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), name)


def _block_names(cut: DataFrame, steps: Steps) -> DataFrame:
    """(row, pos, count, name)"""
    # The set of blocks of a hash: copies are merged before the one shuffle of texts. Blocks are kept where a hash has several, and only there.
    sets = cut.groupBy("h").agg(F.collect_set("block").alias("all"))
    different = sets.select("h", (F.size("all") > 1).alias("shared"), F.explode("all").alias("block")).sortWithinPartitions("block")
    named = steps.keep(different.select("h", F.when(F.col("shared"), F.col("block")).alias("block"), F.monotonically_increasing_id().alias("name")), "block-names")
    places = cut.select("row", "pos", "count", "h")
    by_hash = places.join(named.where(F.col("block").isNull()).select("h", "name"), "h").select("row", "pos", "count", "name")
    shared = named.where(F.col("block").isNotNull())
    if shared.isEmpty():
        return by_hash
    # On the block alone, which is one name's: its hash is what it shares.
    by_text = cut.join(shared.select("block", "name"), "block").select("row", "pos", "count", "name")
    return by_hash.unionByName(by_text)


def identities(cut: DataFrame, steps: Steps) -> DataFrame:
    """(row, level, name) of every document of ``blocks``: equal (level, name), equal text."""
    names, done, level = steps.keep(_block_names(cut, steps), "names-0"), [], 0
    longest = names.agg(F.max("count")).first()[0] or 0
    while True:
        done.append(names.where(F.col("count") == 1).select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        level, longest = level + 1, (longest + 1) // 2
        side = F.col("pos").bitwiseAND(1)
        pairs = names.where(F.col("count") > 1).groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(
            F.first("count").alias("count"), F.max(F.when(side == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(NO_PARTNER)).alias("b")
        )
        pairs = steps.keep(pairs.withColumn("count", F.shiftright(F.col("count") + 1, 1)), f"pairs-{level}")
        known = _sorted_names(pairs.select("a", "b").distinct(), ["a", "b"], steps, f"pair-names-{level}")
        names = steps.keep(pairs.join(known, ["a", "b"]).select("row", "pos", "count", "name"), f"names-{level}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return steps.keep(out, "identities")


def duplicates(docs: DataFrame, steps: Steps | None = None, size: int = BLOCK, hashed=_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: of equal texts the longest as written stays, then the smallest id."""
    steps = steps or Steps(docs.sparkSession)
    cut = blocks(docs, steps, size, hashed)
    heads = cut.where("pos = 0").select("row", "doc_id", "n_chars", "text_sha256")
    rows = steps.keep(heads.join(identities(cut, steps), "row"), "rows")
    steps.drop("blocks")
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    # Written, so that the join below has a plain shuffle on both sides, which can be split where one group is hot.
    groups = steps.keep(rows.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.min(rank).alias("best")), "groups")
    joined = rows.join(groups.select("level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("_row")), ["level", "name"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("_row")).alias("kept"), "text_sha256")
