"""Built-in-expression helpers: metrics, text rules, labels."""
