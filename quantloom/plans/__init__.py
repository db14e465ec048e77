"""The registered queries: importing this package fills ``QUERIES`` and ``SQL``."""

from . import queries
from . import alerts, checks, exposure, factors, features, ledger, live, lots, orders, reports, scans, scenarios, sinks, spacing, strategies, study, universe, volatility  # noqa: F401  isort: skip

QUERIES, SQL = queries.QUERIES, queries.SQL
