"""All queries over the tables, by name, and their SQL."""

from ledgerlens.plans import detection, files, profiling

QUERIES = {**detection.QUERIES, **profiling.QUERIES, **files.QUERIES}
ORACLES = {**detection.ORACLES, **profiling.ORACLES, **files.ORACLES}
