"""From a query string to a logical plan."""
