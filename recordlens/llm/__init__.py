"""Operators that prepare training text: near copies, secrets, archives, filters, packing."""
