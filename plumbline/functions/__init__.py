"""Column functions: text normalisers, canonical identifiers, predicates."""
