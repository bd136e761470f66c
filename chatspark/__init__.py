"""chatspark: chat-message analytics as Spark DataFrame operators.

Layout
  sources/    readers, sinks, the driver tables and derived test relations
  functions/  Column -> Column text and label expressions
  operators/  DataFrame -> DataFrame operators (cleaning, labels, joins,
              features, metrics, topics, models, ordered scans)
  plans/      named queries composed from operators, with DuckDB oracles
  streaming/  Structured Streaming operators and their batch twins
"""

__all__ = ["session"]
