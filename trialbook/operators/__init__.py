"""DataFrame to DataFrame operators over the experiment catalogue."""
