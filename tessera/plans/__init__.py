"""The registered queries over the supplied tables."""

from tessera.plans import contracts, images, records, relational
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "contracts", "images", "records", "relational"]
