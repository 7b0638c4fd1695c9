"""Operators for building training corpora: near copies, token files, secrets, URL lists, mixing, search, packing."""
