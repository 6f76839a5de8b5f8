"""Scalar functions: text analysis, addresses, HTML, robots rules, strings."""
