"""Column builders: conversions and comparisons with the exact rules that documents need."""
