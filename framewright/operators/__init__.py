"""Relational operators over frames, fingerprints and cues."""
