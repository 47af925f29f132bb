"""Column expressions: byte reads, packed numbers, code tables, colour and placement arithmetic."""
