"""Column-level helpers: each returns a pyspark Column built from built-in functions."""

from featpipe.functions.columns import *  # noqa: F401,F403
from featpipe.functions.hashing import *  # noqa: F401,F403
