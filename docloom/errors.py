"""Errors with the numeric codes of the document query language."""

from __future__ import annotations

#: Names of the codes that have one; the others are called Location<code>.
CODE_NAMES = {
    2: "BadValue", 9: "FailedToParse", 14: "TypeMismatch", 20: "IllegalOperation", 26: "NamespaceNotFound", 27: "IndexNotFound", 28: "PathNotViable",
    40: "ConflictingUpdateOperators", 48: "NamespaceExists", 56: "EmptyFieldName", 66: "ImmutableField", 72: "InvalidOptions", 85: "IndexOptionsConflict",
    146: "ExceededMemoryLimit", 171: "CannotIndexParallelArrays", 292: "QueryExceededMemoryLimitNoDiskUseAllowed", 11000: "DuplicateKey",
}


class QueryError(Exception):
    def __init__(self, code: int, message: str, key_pattern: dict | None = None, key_value: dict | None = None):
        super().__init__(message)
        self.code, self.code_name = code, CODE_NAMES.get(code, f"Location{code}")
        self.key_pattern, self.key_value = key_pattern, key_value


class NotSupported(QueryError):
    """A construct outside the supported surface: rejected, never answered silently."""

    def __init__(self, what: str):
        super().__init__(2, f"{what} is not supported")


class BulkWriteError(QueryError):
    def __init__(self, message: str, inserted: int, write_errors: list[dict]):
        super().__init__(write_errors[0]["code"] if write_errors else 2, message)
        self.inserted_count, self.write_errors = inserted, write_errors
