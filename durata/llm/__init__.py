"""Training-data operators: token stores, toxicity and quality scores, BPE,
de-duplication, license scans, decontamination and sharding.

Nothing else in ``durata`` imports this subpackage.  Every operator is a
function from DataFrame to DataFrame; ``queries.py`` holds the thin queries
that apply them to the given tables.
"""
