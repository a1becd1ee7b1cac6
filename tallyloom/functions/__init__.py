"""Column expressions shared by the jobs; each one is a pure Catalyst expression."""
