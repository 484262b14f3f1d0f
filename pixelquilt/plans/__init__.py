"""Cell planning, incremental bookkeeping, cost estimates and reports."""
