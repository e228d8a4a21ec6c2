"""Package `fidelmill.functions`."""
