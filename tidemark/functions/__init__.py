"""Column functions: value kinds, canonical encoding, predicates and expressions."""
