"""Registered queries."""

from . import decisions as decisions
from . import dialogue as dialogue
from . import queries as queries
from . import scale as scale
