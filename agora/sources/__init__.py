"""Sources: fixed schemas, table bundles, fixture derivation, command batches."""
