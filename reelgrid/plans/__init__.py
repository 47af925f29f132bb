"""Reports, derived tables and the registered queries."""
