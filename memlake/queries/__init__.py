"""The registered queries, by area; importing this package registers them."""

from memlake.queries import auditing, combining, filtering, flowing, searching, sweeping  # noqa: F401
from memlake.queries.registry import QUERIES, SQL  # noqa: F401
