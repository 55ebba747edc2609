"""Segments of unsigned 32-bit ids as Spark tables: membership, exact counts, set algebra, maintenance."""
