"""Builders of external media commands. They only describe; nothing here runs a program unless asked."""
