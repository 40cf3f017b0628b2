"""Column expressions: everything here is a pure ``Column -> Column`` function."""
