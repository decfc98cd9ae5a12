"""Plans: the query catalogue and the runtime of JSON plans."""
