"""Index-event feature engine on Spark: events before, during and after an index visit."""
