"""Operations on training text: fingerprints, near copies, leaks, mixing, token files.

One module per operator; ``catalog`` registers their queries and ``sql`` holds
the DuckDB equivalents. Nothing outside this subpackage imports it.
"""
