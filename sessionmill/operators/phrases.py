"""Dictionary terms in message texts, for dictionaries of any size and terms of any characters.

The searches and offsets are those of ``detect``. A term stands between ASCII word boundaries, so it begins and ends where tokens do,
a token being a run of [0-9A-Za-z_] or one other character. Texts are cut into tokens, tokens meet the terms' first tokens in a join, and
what meets is verified by the tokens that follow, which are at hand in its block; of matches that overlap, the first and then the
longest stays. A plan does not grow with the dictionary. Tokens are cut, joined and verified where texts are read, as long as the
dictionary is small enough for Spark to send it around; only hits are brought together again, per message.

In token mode all of it is column expressions. In compat mode texts are cut as arrays of bytes, and only tokens that open a term become
rows; of a dictionary too large to send around, all do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from sessionmill.operators.text import collapse, lower_text

_WORD = "[0-9A-Za-z_]"
TOKEN = f"{_WORD}+|[^0-9A-Za-z_]"

# Tokens that are looked at together.
BLOCK = 64
# Bytes of texts that are cut at once; a longer text is cut by itself.
SLICE_BYTES = 4 << 20
# A dictionary of so many rows is sent to every executor; a larger one meets the tokens in a shuffle.
BROADCAST_ROWS = 500_000
# Places of the two searches lie this far apart.
_PASS = 1 << 40


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def is_word(token: Column) -> Column:
    return token.rlike(f"^{_WORD}")


def _part(parts: Column, begin: Column, count: Column | int) -> Column:
    """``count`` entries, or as many as there are; ``slice`` would go through the whole list for each part."""
    return F.transform(F.sequence(begin, F.least(begin + count, F.size(parts)) - 1), lambda i: F.get(parts, i))


_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"]] = True


def _cut(batches: Iterator[pa.RecordBatch], openings: pa.Array | None, extra: int) -> Iterator[pa.RecordBatch]:
    """A row for each token that opens a term (any, if ``openings`` is None), with ``extra`` tokens behind it and the one before."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_binary())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        begin = 0
        while begin < len(text):
            end = max(int(np.searchsorted(ends, ends[begin] + SLICE_BYTES, side="right")) - 1, begin + 1)
            yield _opened(batch.slice(begin, end - begin), text.buffers()[2], ends[begin : end + 1], openings, extra)
            begin = end


def _opened(batch: pa.RecordBatch, buffer: pa.Buffer, ends: np.ndarray, openings: pa.Array | None, extra: int) -> pa.RecordBatch:
    data, ends = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    # A token begins with each character but a word's second and later ones; texts are not empty.
    word, begins = _IS_WORD[data], data & 0xC0 != 0x80
    begins[1:] &= ~(word[1:] & word[:-1])
    begins[ends[:-1]] = True
    starts = np.flatnonzero(begins)
    offsets = np.append(starts, len(data)).astype(np.int64)
    listed = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    at = np.arange(len(starts)) if openings is None else np.flatnonzero(pc.is_in(listed, value_set=openings).to_numpy(zero_copy_only=False))
    first = np.searchsorted(starts, ends)
    row = np.searchsorted(first, at, side="right") - 1
    count = np.minimum(first[row + 1] - at, extra + 1)
    heads = np.cumsum(count) - count
    behind = listed.take(pa.array(np.repeat(at - heads, count) + np.arange(count.sum()))).cast(pa.string())
    before = listed.take(pa.array(at - 1, mask=at == first[row])).cast(pa.string())
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays([
        batch.column("_message").take(rows), batch.column("_kept").take(rows), batch.column("pass").take(rows), pa.array(at - first[row]),
        pa.array(starts[at] - ends[row]), before, pa.ListArray.from_arrays(pa.array(np.append(heads, count.sum()), pa.int32()), behind),
    ], ["_message", "_kept", "pass", "_place", "start", "_before", "_tokens"])


def _blocks(text: Column, weight, extra: Column) -> Column:
    """array<struct<first, before, tokens, base>>: tokens by ``BLOCK``, each list going on for ``extra`` more, with the token before it
    and the weight of all text before."""
    cut = F.flatten(F.transform(F.array(tokens(text)), lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")),
        lambda b: F.struct((b * BLOCK).alias("first"), F.get(p, b * BLOCK - 1).alias("before"), _part(p, b * BLOCK, BLOCK + extra).alias("tokens")),
    )))
    zero = F.array(F.lit(0).cast("bigint"))
    # Bound to a name by a list of one, so that no lambda works the blocks out again.
    return F.flatten(F.transform(F.array(cut), lambda blocks: F.zip_with(
        blocks,
        F.aggregate(blocks, zero, lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.coalesce(weight(F.slice(b["tokens"], 1, BLOCK)), F.lit(0)))),
        lambda b, base: F.struct(b["first"], b["before"], b["tokens"], base.alias("base")),
    )))


def _words(listed: Column) -> Column:
    return F.size(F.filter(listed, is_word)).cast("bigint")


def _chosen(hits: Column) -> Column:
    """Of overlapping hits in order, each that begins behind the end of the last one chosen."""
    ends = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<bigint>").alias("places"))
    places = F.aggregate(hits, ends, lambda acc, h: F.struct(
        F.when(h["place"] >= acc["end"], h["place"] + h["count"]).otherwise(acc["end"]).alias("end"),
        F.when(h["place"] >= acc["end"], F.array_append(acc["places"], h["place"])).otherwise(acc["places"]).alias("places"),
    ), lambda acc: acc["places"])
    # The longest of a place comes first.
    apart = F.flatten(F.transform(F.array(places), lambda p: F.filter(
        hits, lambda h, i: F.array_contains(p, h["place"]) & ((i == 0) | (F.get(hits, i - 1)["place"] != h["place"]))
    )))
    return F.when(F.size(hits) == 1, hits).otherwise(apart)


def found(messages: DataFrame, lexicon: DataFrame, text: str, keep: Sequence[str], mode: str) -> DataFrame:
    """The rows of ``detect``. ``lexicon`` has word, severity and group, each word once.

    Its rows are counted, up to ``BROADCAST_ROWS``: the size that Spark assumes of texts is that before they are cut to tokens.
    """
    small = lexicon.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    parts = tokens(F.col("word"))
    entry = lexicon.select(
        "word", F.col("group").alias("group_name"), "severity", F.size(parts).alias("count"), F.get(parts, F.lit(0)).alias("_opening"),
        is_word(F.col("word")).alias("_begins"), is_word(F.element_at(parts, -1)).alias("_ends"),
    )
    entry = entry.hint("broadcast" if small else "merge")
    source = messages.where(f"`{text}` is not null and `{text}` <> ''").select(
        F.monotonically_increasing_id().alias("_message"), F.struct(*keep).alias("_kept"), lower_text(F.col(text)).alias("_text"),
        entry.agg(F.max("count")).scalar().alias("_extra"),
    )
    met = _meeting(source, entry, mode, small).withColumn("shorter", -F.col("count"))
    # Hits that overlap, one with the next, are settled together; all of it on one shuffle, by message.
    ordered = Window.partitionBy("_message").orderBy("place", "shorter", "pass")
    reach = F.max(F.col("place") + F.col("count")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    apart = met.withColumn("_apart", (F.col("place") >= F.coalesce(reach, F.lit(0))).cast("int"))
    joined = apart.withColumn("_group", F.sum("_apart").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hit = F.struct("place", "shorter", "pass", "start", "word", "group_name", "severity", "count")
    groups = joined.groupBy("_message", "_group").agg(F.first("_kept").alias("_kept"), F.sort_array(F.collect_list(hit)).alias("_all"))
    chosen = groups.select("_message", "_kept", F.explode(_chosen(F.col("_all"))).alias("_hit"))
    if mode == "compat":  # a match of the second search repeats the one of the first at its offset
        best = F.min(F.struct("_hit.pass", "_hit.start", "_hit.word", "_hit.group_name", "_hit.severity")).alias("_hit")
        chosen = chosen.groupBy("_message", "_hit.start").agg(F.first("_kept").alias("_kept"), best)
    return chosen.select("_kept.*", "_hit.pass", "_hit.start", "_hit.word", "_hit.group_name", "_hit.severity")


def _meeting(source: DataFrame, entry: DataFrame, mode: str, small: bool) -> DataFrame:
    """Places where the tokens of an entry stand: _message, _kept, place, pass, start and the entry."""
    token, after, count = F.col("_token"), F.get("_b.tokens", F.col("_pos") + F.col("count")), F.col("count")
    taken, earlier = F.slice("_b.tokens", F.col("_pos") + 1, count), F.slice("_b.tokens", F.lit(1), F.col("_pos"))
    place = (F.col("_b.first") + F.col("_pos")).cast("bigint")
    if mode == "compat":
        short = collapse(F.col("_text"))
        texts = F.array(F.struct(F.lit(1).alias("pass"), F.col("_text").alias("text")), F.struct(F.lit(2).alias("pass"), short.alias("text")))
        searched = source.select("_message", "_kept", "_extra", "_text", F.explode(texts).alias("_s")).where("_s.pass = 1 OR _s.text <> _text")
        searched = searched.select("_message", "_kept", "_s.pass", "_s.text")
        schema = StructType(searched.schema.fields[:3]).add("_place", "long").add("start", "long").add("_before", "string").add("_tokens", ArrayType(StringType()))
        extra, listed = entry.agg(F.max("count")).first()[0] or 0, None
        if small:
            listed = source.sparkSession.sparkContext.broadcast([r[0] for r in entry.select("_opening").where("_opening IS NOT NULL").distinct().collect()])
        opened = searched.mapInArrow(lambda b: _cut(b, None if listed is None else pa.array(listed.value, pa.large_string()), extra), schema)
        token, before, after = F.get("_tokens", F.lit(0)), F.col("_before"), F.get("_tokens", count)
        bounded = (F.col("_begins") | is_word(before)) & (F.col("_ends") | is_word(after))
        met = opened.join(entry, token == F.col("_opening")).where(bounded & ((count == 1) | (F.array_join(F.slice("_tokens", F.lit(1), count), "") == F.col("word"))))
        return met.select("_message", "_kept", (F.col("pass") * _PASS + F.col("_place")).alias("place"), "pass", "start", "word", "group_name", "severity", "count")
    # A text that does not begin with a word has an empty one in front.
    lead = F.when(~is_word(F.col("_text")), 1).otherwise(0)
    blocks = source.select("_message", "_kept", lead.alias("_lead"), F.explode(_blocks(F.col("_text"), _words, F.col("_extra"))).alias("_b"))
    opened = blocks.select("*", F.posexplode("_b.tokens").alias("_pos", "_written")).where(F.col("_pos") < BLOCK)
    forms = F.array_distinct(F.array(F.col("_written"), collapse(F.col("_written"))))
    met = opened.select("*", F.explode(forms).alias("_token")).join(entry, token == F.col("_opening"))
    way = F.when(F.array_join(taken, "") == F.col("word"), 1).when(F.array_join(F.transform(taken, collapse), "") == F.col("word"), 2)
    return met.withColumn("pass", way).where("pass IS NOT NULL").select(
        "_message", "_kept", place.alias("place"), "pass", (F.col("_b.base") + F.col("_lead") + _words(earlier)).alias("start"), "word", "group_name", "severity", "count"
    )
