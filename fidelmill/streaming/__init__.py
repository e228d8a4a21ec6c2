"""Package `fidelmill.streaming`."""
