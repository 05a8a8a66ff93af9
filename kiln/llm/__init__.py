"""Training-data operators: quality rules, decontamination, secret scans, chat
formatting, sharding, language id, pseudonyms, licence scans, near-dedup, mixing,
Merkle manifest, quality classifier, ranked search.

Nothing else in the library imports this subpackage.
"""
