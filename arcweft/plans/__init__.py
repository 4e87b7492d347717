"""Driver-side plans: patterns, rulebooks, reports, and what cuts a query's lineage."""
