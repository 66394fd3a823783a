"""paysift: grouped price analytics expressed as Spark DataFrame plans.

Every operator takes and returns DataFrames, is lazy, and names its columns
through parameters. Sub-packages:

- ``sources``   scans, sinks and the stand-in tables derived from the test data
- ``functions`` scalar column expressions (native, no Python UDFs)
- ``operators`` cleaning, joins, statistics, features, models, error reports
- ``plans``     composed flows and the query catalog used by the driver
- ``streaming`` the cleaning + region join as an incremental file stream
"""

__version__ = "0.1.0"
