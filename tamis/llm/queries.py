"""The registered queries of the training-data operators."""

from __future__ import annotations

from functools import reduce

from . import classifier, fim, langid, mixing, outliers, packing, repair, secret_scan, sharding, simhash, sketch, trie, warc

MODULES = [repair, warc, mixing, simhash, outliers, sketch, langid, sharding, classifier, packing, trie, fim, secret_scan]
QUERIES: dict = reduce(lambda a, m: a | m.QUERIES, MODULES, {})
ORACLE_SQL: dict[str, str] = reduce(lambda a, m: a | m.ORACLE_SQL, MODULES, {})
