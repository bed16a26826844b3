"""All named queries."""

from tamperlens.plans import queries_files, queries_models, queries_reports, queries_text  # noqa: F401
from tamperlens.plans.registry import CHECKS, QUERIES  # noqa: F401
