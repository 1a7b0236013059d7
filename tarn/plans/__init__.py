"""Report queries and daily jobs composed from the operators."""
