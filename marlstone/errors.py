"""Errors of the engine, arranged as PEP 249 wants them."""


class Warning(Exception):  # noqa: A001, N818
    pass


class Error(Exception):
    pass


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


class DuplicateKey(IntegrityError):
    """An inserted key is already there."""


class KeyNotFound(OperationalError):
    """An update or delete by key found no such key."""


class ConstraintViolation(IntegrityError):
    """NOT NULL, a length or a CHECK failed."""


class SchemaMismatch(ProgrammingError):
    """Columns or types don't fit the table."""


class WriteConflict(OperationalError):
    """Another transaction committed one of the keys first; trying again may succeed."""


class TableNotFound(ProgrammingError):
    pass


class TableExists(ProgrammingError):
    pass


class SqlError(ProgrammingError):
    """The statement can't be understood."""
