"""sparkloom: a Spark-first analytics engine."""

__version__ = "0.1.0"
