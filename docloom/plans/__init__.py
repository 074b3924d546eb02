"""Mappings (declared document views) and what is derived from them before any data is read."""
