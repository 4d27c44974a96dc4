"""footfall: demand analytics for a public service, written as Spark DataFrame jobs.

* ``sources``    readers and writers with declared schemas
* ``functions``  Column expressions (dates, null rules, codes, brackets, curves)
* ``operators``  DataFrame -> DataFrame building blocks (top row per group, exact quantiles, k-means, ...)
* ``plans``      the analyses composed from them (visits, households, training, census, segments, demand, growth, maps)
* ``catalog``    the registered queries over the shared test tables, each with its SQL twin
"""
