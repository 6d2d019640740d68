"""Query plans: fixture derivations and the registered queries (one per
operator ID of the survey) with their DuckDB oracles."""
