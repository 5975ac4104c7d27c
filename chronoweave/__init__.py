"""Chronoweave: a PySpark-native engine for graphs whose facts change over two time axes."""

__version__ = "0.1.0"

from chronoweave.errors import ChronoweaveError, QueryError, SchemaVersionError, StorageError, ValidationError  # noqa: E402
from chronoweave.operators.patterns import Pattern, Var  # noqa: E402
from chronoweave.operators.temporal import GraphDelta, GraphSeries, Spine  # noqa: E402
from chronoweave.operators.metrics import GraphSignal  # noqa: E402
from chronoweave.plans.compiler import compile_statement, execute  # noqa: E402
from chronoweave.plans.language import parse  # noqa: E402
from chronoweave.sources.store import TemporalGraph, open_graph  # noqa: E402

__all__ = [
    "ChronoweaveError", "GraphDelta", "GraphSeries", "GraphSignal", "Pattern", "QueryError", "SchemaVersionError", "Spine",
    "StorageError", "TemporalGraph", "ValidationError", "Var", "compile_statement", "execute", "open_graph", "parse",
]
