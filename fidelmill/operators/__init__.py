"""Package `fidelmill.operators`."""
