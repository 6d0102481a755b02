"""Training-data operators: text, tokens, near-duplicates, leaks, secrets and archives.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
