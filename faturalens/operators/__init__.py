"""DataFrame operators: selection, aggregates, trend, insight, validation, log."""
