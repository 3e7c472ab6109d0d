"""Column expressions: parsing, dates, predicates, redaction, snippets."""
