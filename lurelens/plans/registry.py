"""Registry of named queries: ``name -> (spark query, oracle SQL or None)``.

Each Spark query is ``(spark, sf_dir) -> DataFrame`` over the whole driver
tables (or corpora Spark derives from them).  The oracle SQL is the same
query written independently for DuckDB; ``None`` marks queries that only get
a rows-only check (model fitting, streaming round trips, file sinks).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, doc: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Entry(fn, sql, doc or (fn.__doc__ or "").strip().split("\n")[0])
        return fn
    return deco


def add(name: str, fn: QueryFn, sql: str | None, doc: str = "") -> None:
    REGISTRY[name] = Entry(fn, sql, doc)


def load_all() -> dict[str, Entry]:
    """Imports the query modules (which fill the registry) and returns it."""
    # order matters: later modules reuse the oracle SQL of earlier ones
    from . import q_url  # noqa: F401
    from . import q_email  # noqa: F401
    from . import q_prep  # noqa: F401
    from . import q_models  # noqa: F401
    from . import q_stream  # noqa: F401
    from . import q_io  # noqa: F401
    from . import q_more  # noqa: F401
    return REGISTRY
