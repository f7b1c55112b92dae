"""Imports every operator of this package so that its query is registered."""

from . import decontamination, line_dedup, main_text, mixing, near_dedup, neighbours, periodic, quality, shards, spelling, toxicity, url_rules, warc  # noqa: F401
from .common import JOBS, SQL  # noqa: F401
