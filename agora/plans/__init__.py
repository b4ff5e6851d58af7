"""Query registry and the oracle SQL that checks it."""
