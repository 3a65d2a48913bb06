"""All registered queries. Importing a module registers its queries."""

from cadenza.registry import base
from cadenza.registry import tagging  # noqa: F401
from cadenza.registry import songs  # noqa: F401
from cadenza.registry import text  # noqa: F401
from cadenza.registry import hygiene  # noqa: F401
from cadenza.registry import vectors  # noqa: F401
from cadenza.registry import learning  # noqa: F401
from cadenza.registry import files  # noqa: F401
from cadenza.registry import streams  # noqa: F401
from cadenza.registry import published  # noqa: F401

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL
