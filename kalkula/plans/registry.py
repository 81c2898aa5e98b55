"""All queries of the library by name, with their SQL."""

from kalkula.plans import matching, pricing, recommend, rows, scalars, sheets, sources, weights  # noqa: F401
from kalkula.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
