"""All registered queries."""

from . import views  # noqa: F401
from . import points, access, graph, documents, explorer, state, uploads, trees, images, streams  # noqa: F401
from .registry import QUERIES, Inputs, oracle_text

__all__ = ["QUERIES", "Inputs", "oracle_text"]
