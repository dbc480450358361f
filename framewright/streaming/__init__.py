"""The operators on streams of fingerprints."""
