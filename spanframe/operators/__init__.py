"""DataFrame operators: spans, scores, curation, validation, sampling, strata, registry."""
