"""The five sources behind one interface."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators import detect as D
from sessionmill.operators import pricing as P
from sessionmill.operators.skew import join_facts
from sessionmill.sources import claude, codex, gemini, opencode, pi, readers
from sessionmill.sources.contract import Stage, as_is, join_file_facts

Raw = Any  # a DataFrame, or a dict of three for the relational source


@dataclass(frozen=True)
class Source:
    """How one source is read, parsed and turned into events, messages and hits.

    ``parse`` keeps what events need and no text; ``events`` and ``locate`` work
    on its result, so a job that stores it scans the logs once for events and
    once for terms.
    """

    name: str
    read: Callable[[SparkSession, str], Raw]
    parse: Callable[[Raw], Raw]
    events: Callable[[Raw, DataFrame], DataFrame]
    messages: Callable[[Raw], DataFrame]
    message_rows: Callable[[Raw], DataFrame]
    locate: Callable[[Raw, DataFrame], DataFrame]
    aliased: bool = True

    def hits(
        self,
        raw: Raw,
        lexicon: list[tuple[str, str, str]],
        mode: str = "compat",
        parsed: Raw | None = None,
        stage: Stage = as_is,
    ) -> DataFrame:
        """Term hits of the source's user messages.

        Terms are found before project and folder are joined, so no text is
        ever shuffled, and ``stage`` sees the hits without their texts.
        """
        rows = self.message_rows(raw)
        # What tells one message from another, once its text is gone.
        rows = rows.withColumn("message", F.xxhash64(*rows.columns))
        found = stage(D.detect(rows, lexicon, mode=mode))
        located = self.locate(self.parse(raw) if parsed is None else parsed, found)
        return D.as_hits(located.withColumn("harness", F.lit(self.name)))


def _by_file(facts):
    return lambda parsed, rows: join_file_facts(rows, facts(parsed))


SOURCES = {
    s.name: s
    for s in (
        Source(
            "pi", readers.read_pi, pi.parse, pi.normalize_parsed, pi.messages, pi.message_rows,
            _by_file(pi.message_facts),
        ),
        Source(
            "opencode", lambda spark, home: readers.read_opencode(spark, f"{home}/opencode"), lambda raw: raw,
            opencode.normalize, opencode.messages, opencode.message_rows,
            lambda raw, rows: join_facts(rows, opencode.message_facts(raw), ["message_id"], "inner"),
        ),
        Source(
            "claude", readers.read_claude, claude.parse, claude.normalize_parsed, claude.messages,
            claude.message_rows, _by_file(claude.message_facts),
        ),
        Source(
            "codex", readers.read_codex, codex.parse, codex.normalize_parsed, codex.messages, codex.message_rows,
            lambda parsed, rows: codex.located(rows, parsed),
        ),
        Source(
            "gemini", readers.read_gemini, gemini.parse, gemini.normalize_parsed, gemini.messages,
            gemini.message_rows, lambda parsed, rows: rows, aliased=False,
        ),
    )
}


def discover(spark: SparkSession, home: str) -> dict[str, Raw]:
    """Raw frames of the sources that have files; none at all is an error."""
    found = {name: readers.if_present(s.read, spark, home) for name, s in SOURCES.items()}
    present = {name: raw for name, raw in found.items() if raw is not None}
    if not present:
        raise FileNotFoundError(f"no session sources under {home}")
    return present


@dataclass(frozen=True)
class Prices:
    """The catalogue as listed, and with the alias names laid over it."""

    listed: DataFrame
    overlaid: DataFrame

    @classmethod
    def of(cls, documents: DataFrame, aliases: DataFrame, stage: Stage = as_is) -> Prices:
        """``stage`` may store both: stored, they are worked out once, and Spark knows whether they are small enough to send around."""
        listed = stage(P.price_per_model(P.flatten_catalogue(documents)))
        return cls(listed, stage(P.overlay_aliases(listed, aliases)))


def parse_all(raw: Mapping[str, Raw]) -> dict[str, Raw]:
    return {name: SOURCES[name].parse(frame) for name, frame in raw.items()}


def unified_events(parsed: Mapping[str, Raw], prices: Prices) -> DataFrame:
    parts = [
        SOURCES[name].events(frame, prices.overlaid if SOURCES[name].aliased else prices.listed)
        for name, frame in parsed.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def user_messages(raw: Mapping[str, Raw]) -> DataFrame:
    """All user messages; a lazy frame, since texts are never written."""
    return reduce(DataFrame.unionByName, [SOURCES[name].messages(frame) for name, frame in raw.items()])


def term_hits(
    raw: Mapping[str, Raw],
    lexicon: list[tuple[str, str, str]],
    mode: str = "compat",
    parsed: Mapping[str, Raw] | None = None,
    stage: Callable[[str], Stage] = lambda name: as_is,
) -> DataFrame:
    found = [SOURCES[n].hits(frame, lexicon, mode, parsed and parsed[n], stage(n)) for n, frame in raw.items()]
    return reduce(DataFrame.unionByName, found)
