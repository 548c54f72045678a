"""Jobs over whole tables: rollups, enriched copies, coverage and usage reports."""

from .rollups import *  # noqa: F403
from .usage import *  # noqa: F403
