"""Errors of the engine."""


class QuernError(Exception):
    """Base of all errors raised here."""


class MappingError(QuernError):
    """A mapping that can't be used."""


class IndexError_(QuernError):
    """An index that is missing, exists already or has no data yet."""


class QueryError(QuernError):
    """A query that can't be understood."""
