"""A document analytics engine on PySpark."""

from .errors import (
    DocumentError,
    DocumentTooLarge,
    DuplicateKeyError,
    InvalidBSON,
    InvalidDocument,
    InvalidUpdateDocument,
    OperationFailure,
    UnsupportedType,
)
from .functions.bson import decode, encode
from .functions.objectid import ObjectId
from .operators.distinct import distinct
from .operators.find import Find
from .operators.update import Change
from .plans.typed import compile_filter
from .results import DeleteResult, InsertManyResult, InsertOneResult, UpdateResult
from .store import Collection, Cursor, Database, DocStore

__version__ = "0.1.0"

__all__ = [
    "Change",
    "Collection",
    "Cursor",
    "Database",
    "DeleteResult",
    "DocStore",
    "DocumentError",
    "DocumentTooLarge",
    "DuplicateKeyError",
    "Find",
    "InsertManyResult",
    "InsertOneResult",
    "InvalidBSON",
    "InvalidDocument",
    "InvalidUpdateDocument",
    "ObjectId",
    "OperationFailure",
    "UnsupportedType",
    "UpdateResult",
    "compile_filter",
    "decode",
    "distinct",
    "encode",
]
