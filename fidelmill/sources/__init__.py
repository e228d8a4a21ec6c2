"""Package `fidelmill.sources`."""
