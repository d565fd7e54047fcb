"""Operators that prepare training text. Nothing outside this folder imports it but the entry module and the corpus pipeline."""
