"""Training-data operators: text and embedding de-duplication, search, language ID, secret scans, tokens, packing.

Nothing outside this subpackage imports it.
"""
