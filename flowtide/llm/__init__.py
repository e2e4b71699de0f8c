"""Training-data operators: quality, token output, fixity, fingerprints, URL
rules, scoring, packing, decontamination, similarity join and sharding.

Nothing else in the package imports this subpackage.  ``catalog`` holds the
registered queries and their SQL.
"""
