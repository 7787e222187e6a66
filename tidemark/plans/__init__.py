"""Logical plans of versioned reads: chains and their resolution."""
