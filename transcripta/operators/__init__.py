"""DataFrame -> DataFrame operators, grouped by topic."""
