"""Analytics over fleet inventory, operation feeds and load-test telemetry, on PySpark."""
