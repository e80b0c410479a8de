"""Errors of the engine."""


class DocumentError(Exception):
    """Base of all errors about documents."""


class InvalidBSON(DocumentError):
    """Bytes that aren't a well-formed BSON document."""


class InvalidDocument(DocumentError):
    """A value, filter or replacement that documents can't hold or be matched with."""


class UnsupportedType(DocumentError):
    """A well-formed value of a kind that this engine doesn't hold."""


class DocumentTooLarge(DocumentError):
    """A document beyond 16 MiB."""


class InvalidUpdateDocument(DocumentError):
    """An update that isn't made of $set, $unset and $inc alone."""


class DuplicateKeyError(DocumentError):
    """A write that would break a unique index."""


class OperationFailure(Exception):
    """An operation on an index that doesn't exist, or that conflicts with one."""
