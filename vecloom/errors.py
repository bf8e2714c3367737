"""Errors that operations on vectors and indexes raise."""


class VecloomError(Exception):
    """Base of all errors of this package."""


class DimensionMismatch(VecloomError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"vectors have {got} elements, {expected} are expected")


class DtypeMismatch(VecloomError):
    pass


class KeyAlreadyExists(VecloomError):
    pass


class EmptyIndex(VecloomError):
    pass


class IndexFull(VecloomError):
    pass


class SearchUnfinished(VecloomError):
    pass


class TableExists(VecloomError):
    pass


class TableMissing(VecloomError):
    pass


class InvalidFile(VecloomError):
    pass


class InvalidConfig(VecloomError, ValueError):
    pass
