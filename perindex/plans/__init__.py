"""Feature families, the feature table and the end-to-end jobs."""
