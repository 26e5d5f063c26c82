"""The registered queries of the library, each with the SQL that gives the same rows."""

from . import evaluate, models, panel, records, spatial  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
