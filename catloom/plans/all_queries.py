"""Imports every family so that its queries are registered."""

from . import extraction, files, filtering, jobs, relations, scalars, streams  # noqa: F401
from .catalog import JOBS, SQL  # noqa: F401
