"""Operators for preparing training text. Nothing else in docloom imports this subpackage."""
