"""Training-data operators: sampling, n-gram counts, split overlap, chunks, token ids, leaks, subjects.

Nothing outside this subpackage imports it.
"""
