"""Training-data operators over web-scale document tables.

Nothing outside this subpackage imports it; the entry module adds its queries
only where the subpackage is present.
"""
