"""Registered queries over the sample tables, each with its SQL counterpart."""

from checks import models, reporting, scans, shapes, texts  # noqa: F401
from checks.registry import ORACLE, QUERIES  # noqa: F401
