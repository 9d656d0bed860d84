"""Readers and writers: patches, rule packs, configuration, baselines and code owners."""
