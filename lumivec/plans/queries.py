"""All registered queries of the library's own operators."""

from . import model_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
