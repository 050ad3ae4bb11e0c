"""End-user queries composed from the operators."""
