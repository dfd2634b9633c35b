"""Query plans and the batch and incremental builds."""
