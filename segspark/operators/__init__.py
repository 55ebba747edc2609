"""Operators over effective sets, and the maintenance operators of a store."""
