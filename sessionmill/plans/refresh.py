"""The full rebuild: raw logs -> events -> hits -> rollups, published last.

Every table is written to a folder of its own run.  Each later step reads the
written table back: that cuts the lineage, so a lost executor costs one stage
and not the parsing of the logs.  Readers look up the latest published run, so
they never see new events next to old rollups.  No message text is written.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators import attribution, detect, lexicon, rollups
from sessionmill.operators import pricing as P
from sessionmill.plans import layout
from sessionmill.plans.store import Rollups
from sessionmill.schemas import ATTRIBUTED_HIT, HIT, LEXICON
from sessionmill.sources import readers, registry

PUBLISHED = "published"


def refresh(
    spark: SparkSession,
    home: str,
    out: str,
    catalogue: str,
    dictionary: str | None = None,
    dictionary_mode: str = lexicon.EXTEND,
    collect_terms: bool = True,
    term_mode: str = "compat",
    aliases: tuple[tuple[str, str], ...] = (),
) -> str:
    """Rebuild everything from the logs under ``home``; returns the published run's folder."""
    raw = registry.discover(spark, home)
    prices = registry.Prices.of(readers.read_catalogue(spark, catalogue), P.alias_frame(spark, aliases))
    terms = lexicon.build(spark, dictionary, dictionary_mode) if collect_terms else None
    run = f"{out}/run={dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}"
    write_tables(spark, raw, prices, terms, lambda table: f"{run}/{table}", term_mode, run)
    publish(spark, out, run)
    return run


def write_tables(
    spark: SparkSession,
    raw: Mapping[str, registry.Raw],
    prices: registry.Prices,
    terms: DataFrame | list[tuple[str, str, str]] | None,
    place: Callable[[str], str],
    term_mode: str = "compat",
    bucketed_run: str | None = None,
) -> Rollups:
    """Write all tables, each to the folder ``place`` gives for its name.

    ``terms`` None leaves the hit tables empty and reads no text; a frame is
    written first, and no more of it collected than one expression can hold.
    Events are partitioned by harness, so a question about one reads only its files. The rollups of a ``bucketed_run`` are
    stored in buckets of their session key, whose number is noted in that folder.
    """
    buckets = None

    def store(frame: DataFrame, table: str) -> DataFrame:
        path = place(table)
        if buckets and table in layout.BUCKETED:
            return layout.store(frame, path, buckets)
        parts = ["harness"] if table == "events" else []
        frame.write.mode("overwrite").partitionBy(*parts).parquet(path)
        return spark.read.parquet(path).select(*frame.columns)

    if isinstance(terms, DataFrame):
        terms = store(terms.select(*LEXICON.fieldNames()), "lexicon")
        few = [tuple(row) for row in terms.limit(detect.PATTERN_WORDS + 1).collect()]
        if not few:
            raise ValueError("dictionary is empty")
        terms = few if len(few) <= detect.PATTERN_WORDS else terms
    # The parsed logs, without texts: events take several looks at them.
    parsed = {
        name: store(frame, f"parsed/{name}") if isinstance(frame, DataFrame) else frame
        for name, frame in registry.parse_all(raw).items()
    }
    events = store(registry.unified_events(parsed, prices), "events")
    if bucketed_run:
        buckets = layout.buckets_for(events)
        layout.record(spark, bucketed_run, buckets)
    if terms is None:
        store(spark.createDataFrame([], HIT), "hits_raw")
        hits = store(spark.createDataFrame([], ATTRIBUTED_HIT), "hits")
    else:
        hits = registry.term_hits(
            raw, terms, term_mode, parsed, lambda name: lambda frame: store(frame, f"found/{name}")
        )
        found = store(hits, "hits_raw")
        hits = store(attribution.attribute_hits(found, events), "hits")
    tools = store(rollups.model_tools(events), "model_tools")
    stats = store(rollups.session_model_stats(events, tools), "stats")
    sessions = store(rollups.sessions(events, tools, stats), "sessions")
    return Rollups(events, model_tools=tools, stats=stats, sessions=sessions, hits=hits)


def publish(spark: SparkSession, out: str, run: str) -> None:
    """Make a finished run the one readers load: one appended row, nothing is replaced."""
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("append").parquet(f"{out}/{PUBLISHED}")


def latest_run(spark: SparkSession, out: str) -> str | None:
    try:
        runs = spark.read.schema("run string").parquet(f"{out}/{PUBLISHED}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return runs.agg(F.max("run")).first()[0]


def load_latest(spark: SparkSession, out: str) -> Rollups:
    run = latest_run(spark, out)
    if run is None:
        raise FileNotFoundError(f"no published run under {out}")
    return Rollups.load(spark, run)
