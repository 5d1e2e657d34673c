"""Corpus preparation operators for training data; nothing outside this folder imports them."""
