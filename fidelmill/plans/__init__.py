"""Package `fidelmill.plans`."""
