"""sonoframe: behavioural-signal analytics as PySpark DataFrame operators."""
