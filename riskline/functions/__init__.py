"""Column expressions: encoders, numeric parsing, features, decision rules, formatting."""
