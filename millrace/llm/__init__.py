"""Operators for preparing training text. Nothing else in millrace imports this."""
