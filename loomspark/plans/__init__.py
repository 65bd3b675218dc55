"""From a configuration to a plan."""
