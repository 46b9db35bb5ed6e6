"""Errors of the engine."""


class EngineError(Exception):
    """Any error of this package."""


class IndexStateError(EngineError):
    """The index can't do what was asked of it."""


class StoreError(EngineError):
    """A table of the index can't be read or written."""


class QueryError(EngineError):
    """A query or request that makes no sense."""


class MergeError(EngineError):
    """Compaction failed."""


class SuggestError(EngineError):
    """Suggestions can't be made."""


class ExpansionError(EngineError):
    """Expansions can't be made."""
