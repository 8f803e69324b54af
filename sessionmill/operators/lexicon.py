"""The dictionary of terms: built-in words, files, merging, checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.schemas import LEXICON

SEVERITIES = ("mild", "moderate", "strong")
EXTEND, REPLACE = "extend", "replace"

# The built-in dictionary, "group: severity word word ...".
BUILT_IN = """
fuck: strong fuck fucking fucked fucker fuckin fucks motherfucker motherfucking mothafucka fuckup fuckoff clusterfuck
fuck: strong fuckwit fucktard fuckface fuckhead fukc fukcing fukced fukcer fcuk fcuking fcuked fuk fuking fuked fuker
fuck: strong fuxk fuxking
shit: strong shit shitty shitting shits shitted bullshit horseshit dipshit shitshow shithead shithole shitface
shit: strong shitfaced shitstain shitbag hsit siht shti sjit shjt bulshit bullsht
ass: moderate ass asses
ass: strong asshole assholes jackass dumbass
ass: moderate fatass
ass: strong asshat asswipe
ass: mild badass
damn: moderate damn damned damnit dammit goddamn goddamnit goddammit
bitch: strong bitch bitches bitching bitchy bitchass
bastard: strong bastard bastards
piss: moderate piss pissed pissing pissoff
dick: moderate dick
dick: strong dickhead
crap: moderate crap crappy crapping
hell: mild hell
wtf: mild wtf
stfu: mild stfu
lmfao: mild lmfao
lmao: mild lmao
cunt: strong cunt cunts
"""


def built_in_rows() -> list[tuple[str, str, str]]:
    """(word, severity, group) in the order listed."""
    rows = []
    for line in BUILT_IN.strip().splitlines():
        group, rest = line.split(": ")
        severity, *words = rest.split()
        rows += [(word, severity, group) for word in words]
    return rows


def built_in(spark: SparkSession) -> DataFrame:
    return ordered(spark, built_in_rows())


def ordered(spark: SparkSession, rows: Iterable[tuple[str, str | None, str | None]]) -> DataFrame:
    """Entries with their position, which decides between duplicates."""
    numbered = [(*row, i) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, "word string, severity string, group string, position bigint")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """word[, severity[, group]] lines; an unknown severity becomes moderate.

    The first line is a header if its first cell is 'word' or 'words'.  Lines of
    unequal width, an empty file and a file without any word are errors.
    """
    raw = spark.read.csv(path, mode="FAILFAST", ignoreLeadingWhiteSpace=True, quote='"', escape='"', multiLine=True)
    if not raw.columns:
        raise ValueError(f"dictionary {path} is empty")
    cells = [F.trim(F.coalesce(F.col(c), F.lit(""))) for c in raw.columns] + [F.lit("")] * 2
    position = F.monotonically_increasing_id()
    entries = raw.select(position.alias("position"), cells[0].alias("word"), F.lower(cells[1]).alias("severity"),
                         cells[2].alias("group"))
    header = (F.col("position") == 0) & F.lower("word").isin("word", "words")
    entries = entries.where((F.col("word") != "") & ~header)
    if entries.isEmpty():
        raise ValueError(f"dictionary {path} contains no valid words")
    known = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("moderate")
    return entries.select("word", known.alias("severity"), _or_word(F.col("group")).alias("group"), "position")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of {word, severity, group}; an unknown severity is an error (see ``merge``). An empty array is no entries."""
    entries = (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.from_json("value", "array<struct<word: string, severity: string, group: string>>")))
        .select("col.word", "col.severity", "col.group", F.col("pos").cast("bigint").alias("position"))
    )
    if entries.isEmpty() and spark.read.text(path, wholetext=True).where(r"value RLIKE '^\\s*\\[\\s*\\]\\s*$'").isEmpty():
        raise ValueError(f"dictionary {path} is empty or no JSON array")
    return entries


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_json(spark, path)


def _or_word(group: Column) -> Column:
    return F.when(F.trim(F.coalesce(group, F.lit(""))) == "", F.col("word")).otherwise(group)


def merge(default: DataFrame, custom: DataFrame | None = None, mode: str = EXTEND) -> DataFrame:
    """One row per lower-cased word; the last entry wins, custom after default.

    'replace' takes the custom entries alone; any other mode extends.  An empty
    word or an unknown severity fails the query that reads the result.
    """
    parts = [default.withColumn("layer", F.lit(0))]
    if custom is not None:
        parts = [custom.withColumn("layer", F.lit(1))] if mode == REPLACE else [
            *parts, custom.withColumn("layer", F.lit(1))
        ]
    entries = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    word = F.lower(F.trim("word"))
    severity = F.when(F.coalesce("severity", F.lit("")) == "", "moderate").otherwise(F.col("severity"))
    fail = F.raise_error
    checked = entries.select(
        F.when(F.coalesce(word, F.lit("")) != "", word).otherwise(
            fail(F.lit("dictionary contains an empty word"))
        ).alias("word"),
        F.when(severity.isin(*SEVERITIES), severity).otherwise(
            fail(F.concat(F.lit("invalid severity for word "), F.col("word")))
        ).alias("severity"),
        "group", "layer", "position",
    )
    group = F.lower(F.trim(_or_word(F.col("group"))))
    latest = F.max_by(F.struct("severity", group.alias("group")), F.struct("layer", "position"))
    return checked.groupBy("word").agg(latest.alias("entry")).select("word", "entry.severity", "entry.group")


def build(spark: SparkSession, path: str | None = None, mode: str = EXTEND) -> DataFrame:
    return merge(built_in(spark), read(spark, path) if path else None, mode)


def write_csv(lexicon: DataFrame, path: str) -> None:
    """Export with a header line; one file, since a lexicon is small."""
    lexicon.select("word", "severity", "group").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def info(lexicon: DataFrame, path: str | None = None, mode: str = EXTEND) -> DataFrame:
    """One row: number of words, file, mode."""
    effective = REPLACE if mode == REPLACE else EXTEND
    return lexicon.agg(F.count(F.lit(1)).alias("words")).select(
        "words", F.lit(path or "").alias("custom_path"), F.lit(effective).alias("mode")
    )


def entries(lexicon: DataFrame) -> list[tuple[str, str, str]]:
    """The lexicon as plain rows."""
    rows = lexicon.select(*LEXICON.fieldNames()).collect()
    if not rows:
        raise ValueError("dictionary is empty")
    return [tuple(r) for r in rows]
