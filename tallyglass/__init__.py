"""Query-log analytics as plain Spark DataFrame transformations.

Query-completed events (one JSON document per finished query) become a typed,
day-partitioned query log; lists, lookups, reports and upkeep jobs are
``DataFrame -> DataFrame`` functions over that log.
"""
