"""Training-data operators: extraction, counting, filtering, deduplication, mixing, packing, storage.

Every module offers a general operator; ``queries`` wraps each one into a thin
query with the columns of its published contract. Nothing else in the library
imports this subpackage.
"""
