"""Column expressions: ids, literals, text helpers, skew-safe ordering."""
