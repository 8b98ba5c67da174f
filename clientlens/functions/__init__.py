"""Column functions over log entries, hosts and User-Agents."""
