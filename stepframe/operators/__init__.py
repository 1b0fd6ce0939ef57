"""Operators on keyed tables: components, coupling, forcing, keyed columns, scenes."""
