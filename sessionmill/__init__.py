"""Analytics over coding-agent session logs, written as Spark DataFrame plans.

The package is layered the way the data flows:

``sources``    raw logs -> one event contract, one message contract
``operators``  pricing, as-of attribution, rollups, term detection
``plans``      the dashboard questions, page bundles and the batch refresh
``streaming``  incremental ingest of landed files
``functions``  column builders shared by all of them
"""

from sessionmill.plans.filters import Filters
from sessionmill.plans.store import Rollups
from sessionmill.session import build_session

__all__ = ["Filters", "Rollups", "build_session"]
