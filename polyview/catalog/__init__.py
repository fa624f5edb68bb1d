"""All runnable queries."""

from polyview.catalog import accuracy, boxes, evaluation, labels, linking, ordered, points, robust, sources, vectors  # noqa: F401
from polyview.catalog.registry import CHECKS, QUERIES  # noqa: F401
