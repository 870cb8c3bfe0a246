"""Dataset operators: services, clone grouping, pairs, metrics, filters, history."""
