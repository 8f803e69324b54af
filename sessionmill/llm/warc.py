"""Merkle fixity audit of archive replicas.

Records are hashed where they are read; their digests, ordered by offset, are leaves. A block is the digests of the records that
begin in a range of ``BLOCK`` bytes of an archive, and a node of the next level is the digests of ``FAN`` neighbouring
ranges, up to one root per archive. Ranges are of offsets, not of ordinal numbers, so a lost record changes the blocks it was
in and no others. The audit compares the roots of two replicas and goes on with the children of unequal nodes only, until it has the records.

Everything is DataFrame operations. No payload is shuffled: a record is its archive, offset, length and digest from the first
step on. A node has at most ``FAN`` children and a block the records of ``BLOCK`` bytes, whatever the archive's size.

Defined results: a null url or payload is an empty one; a page without an id goes to an archive by its hash; equal pages are one record with a
number of copies, and the audit judges them together; an archive that one replica lacks is a root that differs; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionmill.llm.frames import Steps

BLOCK, FAN = 1 << 16, 16
ARCHIVE_IDS = 1024
CRLF = "\r\n"


def record(url: Column, payload: Column) -> Column:
    """A resource record as it stands in an archive."""
    url, payload = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), url, F.lit(f"{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(CRLF * 2), payload, F.lit(CRLF * 2),
    )


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def index(pages: DataFrame, replica: Column | None = None) -> DataFrame:
    """archive, offset, length, copies, page_id, digest of every record; with ``replica``, a column of the bytes that a second
    copy holds at that place (null: nothing), also ``other``, their digest.

    ``pages`` has page_id, url and html. Archives are blocks of ``ARCHIVE_IDS`` ids, ordered by id, then digest.
    """
    text = record(F.col("url"), F.col("html"))
    other = F.lit(None).cast("string") if replica is None else digest(replica)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.octet_length(text).cast("long").alias("length"), digest(text).alias("digest"), other.alias("other")
    )
    same = rows.groupBy("page_id", "length", "digest", "other").agg(F.count("*").alias("copies"))
    archive = F.coalesce(F.floor(F.col("page_id") / ARCHIVE_IDS), -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 20)))
    before = Window.partitionBy("archive").orderBy("page_id", "digest", F.col("other").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long")
    return same.withColumn("archive", archive.cast("long")).withColumn("offset", offset)


def leaves(records: DataFrame, of: str = "digest") -> DataFrame:
    """(archive, offset, length, digest) of the records that a replica holds; ``copies``, if there, is part of the digest."""
    held = F.concat(F.col(of), F.lit("x"), F.col("copies").cast("string")) if "copies" in records.columns else F.col(of)
    return records.where(F.col(of).isNotNull()).select("archive", "offset", "length", held.alias("digest"))


def _node(place: str) -> Column:
    """The digest of children in their order, each with its place."""
    child = F.struct(F.col(place).cast("long").alias("place"), F.col("digest"))
    listed = F.array_sort(F.collect_list(child))
    return F.sha2(F.concat_ws(";", F.transform(listed, lambda c: F.concat_ws(":", c["place"].cast("string"), c["digest"]))).cast("binary"), 256)


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (archive, node, digest): blocks first, roots last."""
    out = [leaf.groupBy("archive", F.floor(F.col("offset") / BLOCK).alias("node")).agg(_node("offset").alias("digest"))]
    for _ in range(levels - 1):
        lower = out[-1].withColumn("above", F.floor(F.col("node") / FAN))
        out.append(lower.groupBy("archive", "above").agg(_node("node").alias("digest")).withColumnRenamed("above", "node"))
    return out


def levels_for(largest_offset: int) -> int:
    levels, reach = 1, BLOCK
    while reach <= largest_offset:
        levels, reach = levels + 1, reach * FAN
    return levels


def _unequal(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    both = one.select(*keys, F.col("digest").alias("d1")).join(two.select(*keys, F.col("digest").alias("d2")), keys, "full_outer")
    return both.where(~F.col("d1").eqNullSafe(F.col("d2")))


def audit(one: DataFrame, two: DataFrame, steps: Steps) -> DataFrame:
    """(archive, offset, status) of the places where two replicas' leaves differ: corrupt, missing (from two) or extra."""
    one, two = steps.keep(one, "one"), steps.keep(two, "two")
    largest = one.unionByName(two).agg(F.max("offset")).first()[0]
    levels = levels_for(largest or 0)
    trees = [[steps.keep(t, f"{name}-{i}") for i, t in enumerate(tree(side, levels))] for name, side in (("a", one), ("b", two))]
    bad = _unequal(trees[0][-1], trees[1][-1], ["archive", "node"]).select("archive", "node")
    for level in range(levels - 2, -1, -1):
        parents = bad.withColumnRenamed("node", "above")
        children = [
            t[level].withColumn("above", F.floor(F.col("node") / FAN)).join(parents, ["archive", "above"], "left_semi") for t in trees
        ]
        bad = _unequal(*children, ["archive", "node"]).select("archive", "node")
    blocks = bad
    records = [
        side.withColumn("node", F.floor(F.col("offset") / BLOCK)).join(blocks, ["archive", "node"], "left_semi") for side in (one, two)
    ]
    status = F.when(F.col("d2").isNull(), "missing").when(F.col("d1").isNull(), "extra").otherwise("corrupt")
    return _unequal(*records, ["archive", "offset"]).select("archive", "offset", status.alias("status"))


def audited(pages: DataFrame, replica: Column) -> DataFrame:
    """Every record of ``pages`` with what the audit says of the second copy, whose bytes ``replica`` gives."""
    steps = Steps(pages.sparkSession)
    rows = steps.keep(index(pages, replica), "index")
    found = audit(leaves(rows), leaves(rows, "other"), steps)
    return rows.join(found, ["archive", "offset"], "left").select(
        "page_id", "archive", "offset", "length", "copies", "digest", F.coalesce("status", F.lit("ok")).alias("status")
    )
