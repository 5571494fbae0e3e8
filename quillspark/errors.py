"""Errors of the library."""


class QuillError(Exception):
    """Base of all of them."""


class EntityNotFound(QuillError):
    pass


class UnknownColumn(QuillError):
    pass


class InvalidQuery(QuillError):
    pass


class OptimisticLockError(QuillError):
    pass


class ValidationError(QuillError):
    pass


class TenantError(QuillError):
    pass
