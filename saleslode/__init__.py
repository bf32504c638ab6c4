"""saleslode: layered sales and economic analytics expressed as Spark jobs.

Every public function takes and returns ``pyspark.sql.DataFrame``; the layers are

* ``sources``   - CSV / JSON landing, batch-versioned lake reads, logical tables
* ``functions`` - column expressions (coercion, text, calendar, money)
* ``operators`` - reusable frame-to-frame operators (flags, series, ranks, rules)
* ``plans``     - Bronze, Silver, Gold, warehouse, models, analytics, ML, serving
* ``sinks``     - Bronze append, overwrite, report and run-log writers
"""
