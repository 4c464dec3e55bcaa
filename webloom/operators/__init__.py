"""Relational operators: PageRank, inverted index, search, frontier, key/value log."""
