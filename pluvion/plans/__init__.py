"""End-to-end indices and risk products built from the operators."""
