"""One hierarchy for everything that can be refused."""


class LoamstoneError(Exception):
    """Base of all errors of the engine; ``status`` is what an HTTP face would answer."""

    status = 500


class UnsupportedSource(LoamstoneError):
    status = 415


class NotFound(LoamstoneError):
    status = 404


class NotRetryable(LoamstoneError):
    status = 409


class InvalidArgument(LoamstoneError, ValueError):
    status = 422


class DuplicateDocument(InvalidArgument):
    """A document is stored already and replacing it was not asked for."""


class DanglingEdge(InvalidArgument):
    """An edge names an element that does not exist."""
