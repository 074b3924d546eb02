"""DataFrame operators: views, changes, incremental maintenance, write sets, reconciliation, replay, history."""
