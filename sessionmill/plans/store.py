"""The tables the dashboard reads, computed on demand or loaded from a run."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.operators import rollups
from sessionmill.operators.attribution import attribute_hits
from sessionmill.plans import layout
from sessionmill.schemas import ATTRIBUTED_HIT, SESSION_KEY

TABLES = ("events", "model_tools", "stats", "sessions", "hits")


class Rollups:
    """Events, the three rollups and the attributed term hits.

    A table is planned when a question first asks for it; tables given by name
    are used as they are.
    """

    def __init__(
        self, events: DataFrame, raw_hits: DataFrame | None = None, **tables: DataFrame
    ):
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise TypeError(f"unknown tables {sorted(unknown)}")
        self.events = events
        self._raw_hits = raw_hits
        # A given table takes the place of the property of its name.
        self.__dict__.update(tables)

    @cached_property
    def model_tools(self) -> DataFrame:
        return rollups.model_tools(self.events)

    @cached_property
    def stats(self) -> DataFrame:
        return rollups.session_model_stats(self.events, self.model_tools)

    @cached_property
    def session_facts(self) -> DataFrame:
        """Sessions without the lists that need attribution; all that most questions ask for."""
        given = self.__dict__.get("sessions")
        return rollups.session_facts(self.events) if given is None else given

    @cached_property
    def session_tools(self) -> DataFrame:
        """(session, tool) of every tool named in a session, one small row each."""
        given = self.__dict__.get("sessions")
        if given is None:
            return self.events.where("tool IS NOT NULL").select(*SESSION_KEY, "tool").distinct()
        return given.select(*SESSION_KEY, F.explode(F.map_keys("tool_breakdown")).alias("tool"))

    @cached_property
    def sessions(self) -> DataFrame:
        return rollups.sessions(self.events, self.model_tools, self.stats)

    def sessions_of(self, few: DataFrame) -> DataFrame:
        """Full session rows of a handful of sessions, given by key; ``few`` is sent to every executor.

        Sessions do not depend on each other, so where the session table has to
        be computed, it is computed from the events of these sessions alone.
        """
        keys = F.broadcast(few.select(*SESSION_KEY))
        if "sessions" in self.__dict__:
            return self.sessions.join(keys, SESSION_KEY, "left_semi")
        return Rollups(self.events.join(keys, SESSION_KEY, "left_semi")).sessions

    @cached_property
    def hits(self) -> DataFrame:
        """Attributed hits; empty where no terms were collected."""
        if self._raw_hits is None:
            return self.events.sparkSession.createDataFrame([], ATTRIBUTED_HIT)
        return attribute_hits(self._raw_hits, self.events)

    @classmethod
    def load(cls, spark: SparkSession, run: str) -> Rollups:
        """The tables of a run, the rollups in the buckets they were stored in."""
        buckets = layout.recorded(spark, run)

        def table(name: str) -> DataFrame:
            path = f"{run}/{name}"
            return layout.load(spark, path, buckets) if buckets and name in layout.BUCKETED else spark.read.parquet(path)

        return cls(**{name: table(name) for name in TABLES})
