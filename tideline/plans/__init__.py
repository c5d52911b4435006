"""All queries of the market engine, by operator name, with their SQL."""

from tideline.plans import analytics, core, markets  # noqa: F401
from tideline.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
