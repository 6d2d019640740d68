"""Column-level helpers (all JVM-side expressions unless stated)."""

from transcripta.functions.columns import (  # noqa: F401
    nan_to_null, parse_list, round_doubles, round_numeric,
)
from transcripta.functions.stats import (  # noqa: F401
    bh_adjust, log_factorial, normal_two_sided_p, t_two_sided_p,
)
