"""Training-data operators: archives, secret scans, URL filters, deduplication,
tokenisation, nearest neighbours, mixing, language identification and sharding.

Nothing outside this subpackage imports it.
"""
