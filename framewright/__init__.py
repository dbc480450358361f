"""Media timelines on Spark: frame fingerprints and subtitle cues as DataFrames."""
