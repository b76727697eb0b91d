"""Errors of the query language, by the layer that finds them."""


class QueryError(Exception):
    """Any error of a query."""


class SyntaxFault(QueryError):
    """The text cannot be read."""


class PlanFault(QueryError):
    """The text reads well but cannot be planned; found before any data is touched."""


class WriteConflict(QueryError):
    """Another writer committed first, on every attempt."""
