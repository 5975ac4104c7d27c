"""Exceptions raised by the engine."""


class ChronoweaveError(Exception):
    """Base of every error the engine raises on purpose."""


class ValidationError(ChronoweaveError):
    """An argument (identifier, date, step, depth) is not acceptable."""


class StorageError(ChronoweaveError):
    """A store cannot be opened, written or read."""


class SchemaVersionError(StorageError):
    """A store was written with another schema version."""


class QueryError(ChronoweaveError):
    """A statement cannot be parsed or compiled."""
