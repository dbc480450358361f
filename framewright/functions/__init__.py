"""Column functions: fingerprint algebra, time, text, and Arrow-based functions where Catalyst has none."""
