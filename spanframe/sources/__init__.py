"""Readers and writers: IOB2, prediction contracts, run directories, corpora, mappings."""
