"""Dictionary terms in message texts.

A text is searched twice: in lower case, and, if that differs, with every run
of one repeated character collapsed to one ('shiiit' -> 'shit').  A match of
the second search is skipped when the first found something at the same byte
offset.  Offsets of the second search count in the collapsed, shorter text, so
a term behind a collapsed run is found again; ``mode='token'`` counts every
occurrence once instead.

All of it is column expressions: matches are marked by a replacement, the text is cut at the marks, and the
lengths of the pieces give the byte offsets.  No text is shuffled: texts become hits where they are read.

One expression of all words serves dictionaries of up to ``PATTERN_WORDS`` rows. A dictionary that comes as a frame or is larger, or
whose terms are more than single words in token mode, is joined to the texts' tokens instead (``phrases``): the hits are the same.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.operators import phrases
from sessionmill.operators.text import collapse, lower_text
from sessionmill.schemas import HIT

_WORD = "[0-9A-Za-z_]"
# Words that one regular expression tries at every place of a text; more are found by a join, with the same result.
PATTERN_WORDS = 200


def pattern(words: Sequence[str]) -> str:
    """Alternation of the words, longest first, between ASCII word boundaries.

    Java's own ``\\b`` knows Unicode letters; the boundary meant here is between
    a character of [0-9A-Za-z_] and anything else, spelled out per word end.
    """
    ranked = sorted(words, key=lambda w: (-len(w), w))
    inner = re.compile(_WORD)
    if all(inner.fullmatch(w[0]) and inner.fullmatch(w[-1]) for w in ranked):
        return f"(?<!{_WORD})(?:{'|'.join(map(_quote, ranked))})(?!{_WORD})"

    def bounded(w: str) -> str:
        before = "(?<!" if inner.fullmatch(w[0]) else "(?<="
        after = "(?!" if inner.fullmatch(w[-1]) else "(?="
        return f"{before}{_WORD}){_quote(w)}{after}{_WORD})"

    return f"(?:{'|'.join(map(bounded, ranked))})"


def _quote(word: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", word)


# Stands around matches while they are located; in a text it counts as another control character.
MARK, OTHER = "\u0001", "\u0002"


BLOCK = 512  # pieces; an even number, so that the second of each two is a match in every block


def _blocks(text: Column, expression: str) -> Column:
    """The matches of each ``BLOCK`` pieces and the pieces' length in bytes.

    Matches are marked, the text is cut at the marks, and a piece starts where the bytes before it end. Sums run within blocks,
    so a list grows by appending to at most ``BLOCK`` entries.
    """
    pieces = F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), expression, f"{MARK}$0{MARK}"), MARK)

    def summed(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("nth"), F.array().cast(_PLACES).alias("found")),
            lambda acc, piece: F.struct(
                (acc["at"] + F.octet_length(piece)).alias("at"),
                (acc["nth"] + 1).alias("nth"),
                F.when(acc["nth"] % 2 == 1, F.array_append(acc["found"], F.struct(acc["at"].alias("start"), piece.alias("word"))))
                .otherwise(acc["found"]).alias("found"),
            ),
        )

    # Pieces are cut into blocks first, so that no lambda works the text out again.
    nested = F.transform(F.array(pieces), lambda p: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, BLOCK)
    ))
    return F.transform(F.flatten(nested), summed)


def _places(blocks: str, number: int) -> Column:
    """(start, pass, word) of all matches of a column of blocks."""
    bases = F.aggregate(
        blocks, F.array(F.lit(0).cast("bigint")), lambda acc, block: F.array_append(acc, F.element_at(acc, -1) + block["at"])
    )
    return F.flatten(F.filter(F.zip_with(blocks, bases, lambda block, base: F.transform(
        block["found"], lambda p: F.struct((p["start"] + base).alias("start"), F.lit(number).alias("pass"), p["word"].alias("word"))
    )), lambda listed: listed.isNotNull()))


_PLACES = "array<struct<start: bigint, word: string>>"


def detect(
    messages: DataFrame,
    lexicon: DataFrame | Sequence[tuple[str, str, str]],
    text: str = "text",
    keep: Sequence[str] | None = None,
    mode: str = "compat",
) -> DataFrame:
    """One row per hit: kept columns, ``pass``, ``start``, word, group_name, severity.

    ``lexicon`` has word, severity and group, each word once: a frame as ``lexicon.merge`` gives it, or rows. ``start`` is a byte
    offset, in token mode the number of words before (one more if the text does not begin with a word). In token mode a term is found
    where its tokens are, as written or else each with its repeats collapsed, and no token is in two hits.
    """
    if mode not in ("compat", "token"):
        raise ValueError("mode is 'compat' or 'token'")
    keep = list(keep) if keep is not None else [c for c in messages.columns if c != text]
    if not isinstance(lexicon, DataFrame):
        lexicon = [tuple(row) for row in lexicon]
        if len(lexicon) > PATTERN_WORDS or (mode == "token" and not all(re.fullmatch(f"{_WORD}+", w) for w, _, _ in lexicon)):
            lexicon = messages.sparkSession.createDataFrame(lexicon, "word string, severity string, group string")
    if isinstance(lexicon, DataFrame):
        return phrases.found(messages, lexicon, text, keep, mode)
    words = [w for w, _, _ in lexicon]
    source = messages.where(f"`{text}` is not null and `{text}` <> ''")
    found = _compat(source, text, words, keep) if mode == "compat" else _token(source, text, words, keep)

    # The words that were found meet the dictionary as a frame of at most PATTERN_WORDS rows. It is sent around: Spark does not know
    # the size of rows from Python and would shuffle the hits by word, all of a frequent word to one task.
    entry = messages.sparkSession.createDataFrame(
        [(w, g, s) for w, s, g in lexicon], "word string, group_name string, severity string"
    )
    joined = found.select(*keep, "hit.pass", "hit.start", "hit.word").join(F.broadcast(entry), "word")
    return joined.select(*keep, "pass", "start", "word", "group_name", "severity")


def _compat(source: DataFrame, text: str, words: Sequence[str], keep: list[str]) -> DataFrame:
    expression = pattern(words)
    low = source.select(*keep, lower_text(F.col(text)).alias("_low"))
    both = low.select(*keep, "_low", collapse(F.col("_low")).alias("_short"))
    # Most messages contain no term: a plain search decides before anything is marked.
    hopeful = both.where(F.col("_low").rlike(expression) | F.col("_short").rlike(expression))
    blocks = hopeful.select(
        *keep, _blocks(F.col("_low"), expression).alias("_first"),
        F.when(F.col("_short") != F.col("_low"), _blocks(F.col("_short"), expression)).alias("_second"),
    )
    none = F.array().cast("array<struct<start: bigint, pass: int, word: string>>")
    every = blocks.select(*keep, F.array_sort(F.concat(_places("_first", 1), F.coalesce(_places("_second", 2), none))).alias("_all"))
    # In the order of starts a match of the second search follows the one of the first that it repeats.
    before = F.concat(F.slice(none, 1, 0), F.array(F.lit(None)), F.slice("_all", 1, F.greatest(F.size("_all") - 1, F.lit(0))))
    paired = every.select(*keep, F.zip_with("_all", before, lambda hit, last: F.struct(
        hit.alias("hit"), (last.isNull() | (hit["pass"] == 1) | (last["start"] != hit["start"])).alias("fresh")
    )).alias("_pairs"))
    return paired.select(*keep, F.explode(F.filter("_pairs", lambda p: p["fresh"] & p["hit"].isNotNull())).alias("_pair")).select(
        *keep, F.col("_pair.hit").alias("hit")
    )


def _token(source: DataFrame, text: str, words: Sequence[str], keep: list[str]) -> DataFrame:
    """Each token once: as written, else with its repeats collapsed; ``start`` is the token's position."""
    tokens = F.split(lower_text(F.col(text)), f"(?:(?!{_WORD})(?s:.))+")
    exploded = source.select(*keep, F.posexplode(tokens).alias("start", "_token"))
    listed = source.sparkSession.createDataFrame([(w,) for w in words], "_word string")
    written = F.broadcast(listed.select(F.col("_word").alias("_token"), F.lit(1).alias("_plain")))
    plain = exploded.join(written, "_token", "left")
    short = plain.withColumn("_word", F.when(F.col("_plain") == 1, F.col("_token")).otherwise(collapse(F.col("_token"))))
    return short.join(F.broadcast(listed), "_word", "left_semi").select(
        *keep,
        F.struct(
            F.when(F.col("_plain") == 1, 1).otherwise(2).alias("pass"), F.col("start").cast("bigint").alias("start"),
            F.col("_word").alias("word"),
        ).alias("hit"),
    )


def as_hits(found: DataFrame) -> DataFrame:
    """Detector output of messages projected to the hit contract.

    A NULL time counts as 0 and a NULL project as ''. ``hit_id`` is a hash of the hit, of what else the row says of its
    message, and of a number that tells apart hits that are equal in all of that.
    """
    same = found.groupBy(*[F.col(f"`{c}`") for c in found.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    each = same.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).drop("_copies")
    hit_id = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(each.columns)])
    return each.select(
        hit_id.alias("hit_id"), "harness", "filename", F.coalesce("project", F.lit("")).alias("project"),
        F.coalesce("ts", F.lit(0)).cast("bigint").alias("ts"), "word", "group_name", "severity",
    ).select(*HIT.fieldNames())
