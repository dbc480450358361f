"""Readers and writers: subtitles, fingerprint files, media probes, frames."""
