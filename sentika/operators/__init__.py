"""DataFrame operators: selection, sampling, counting, metrics, models."""
