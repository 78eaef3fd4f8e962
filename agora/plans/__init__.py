"""Named queries over the driver's tables."""

from . import behaviour, contents, gates, knowledge, landings, lookups, news, people, proofs, reads, records, repairs, reports, versions  # noqa: F401  they register themselves
from .registry import COVERS, QUERIES, SQL  # noqa: F401
