"""DataFrame operators: pixels and layers, palettes, ordered rows, keyed lookups and merges, sound."""
