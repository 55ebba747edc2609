"""Plan builders: tier merge, chunk index, budget."""
