"""Column expressions: business rules, numbers and text."""
