"""Errors by kind, so that callers can tell a wrong request from a missing table."""


class LookupFailed(Exception):
    """Base of all errors of this package."""


class InvalidArgument(LookupFailed):
    pass


class Unimplemented(LookupFailed):
    pass


class NotFound(LookupFailed):
    pass


class AlreadyExists(LookupFailed):
    pass


class OutOfRange(LookupFailed):
    pass


class FailedPrecondition(LookupFailed):
    pass


class PermissionDenied(LookupFailed):
    pass


class ResourceExhausted(LookupFailed):
    pass
