"""Driver-side plan inputs: the period calendar, rule packs and the registered checks."""
