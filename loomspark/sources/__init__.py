"""Sources of log lines and small tables, and generators."""
