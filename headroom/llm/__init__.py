"""Operators for preparing training text: documents in, decisions per document out."""
