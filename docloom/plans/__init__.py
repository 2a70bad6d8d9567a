"""Query parsing, constraints and whole retrieval plans."""
