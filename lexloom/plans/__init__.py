"""Queries over the driver's tables, one for each operator that they can exercise."""

from lexloom.plans import dated, retrieval, sets, storage, streams, texts
from lexloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dated", "retrieval", "sets", "storage", "streams", "texts"]
