"""Query views composed from operators."""
