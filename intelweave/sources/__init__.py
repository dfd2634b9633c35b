"""Tables in and out of the engine."""
