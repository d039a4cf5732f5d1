"""What a service around the engine answers with: probes of its stores, and the status of each typed error."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..config import BoundError
from ..providers import OutputError
from ..sources.artifacts import DownloadError
from .retrieval import EntityAmbiguous, EntityNotFound, Store

# The status of an error; the first class that fits decides.
STATUS = [
    (EntityNotFound, 404),
    (EntityAmbiguous, 409),
    (OutputError, 502),
    (BoundError, 400),
    (TimeoutError, 504),
    (DownloadError, 502),
    (FileNotFoundError, 404),
    (ConnectionError, 503),
    (PySparkException, 503),
    (Py4JError, 503),
    (ValueError, 422),
]
FAULT = 500


def status_of(error: BaseException) -> int:
    """The status that an error is answered with; what has none is a fault of the program."""
    return next((status for kind, status in STATUS if isinstance(error, kind)), FAULT)


def _probe(table: DataFrame) -> str:
    try:
        table.take(1)
        return "connected"
    except (PySparkException, Py4JError):
        return "unreachable"


def health(spark: SparkSession, store: Store | None = None) -> dict[str, str]:
    """Liveness never depends on a store; each store says for itself whether it can be read."""
    stores = {"vectors": store.vectors, "nodes": store.nodes, "edges": store.edges} if store else {}
    alive = not spark.sparkContext._jsc.sc().isStopped()
    return {"status": "healthy" if alive else "unhealthy", **{name: _probe(t) if alive else "unreachable" for name, t in stores.items()}}
