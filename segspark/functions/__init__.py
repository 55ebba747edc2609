"""Pure functions: ids, names, bitmaps, cost, shards."""
