"""Document queries, pipelines and updates on Spark."""

from docloom.errors import BulkWriteError, NotSupported, QueryError
from docloom.plans.filters import Regex
from docloom.values import MISSING, ObjectId

__all__ = ["MISSING", "BulkWriteError", "Client", "NotSupported", "ObjectId", "QueryError", "Regex"]


def __getattr__(name: str):
    if name == "Client":
        from docloom.sources.client import Client

        return Client
    raise AttributeError(name)
