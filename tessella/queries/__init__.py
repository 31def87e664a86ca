"""The library's named queries, by area."""
