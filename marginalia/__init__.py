"""marginalia: Spark-native analytics over annotated text.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Sub-packages:

* ``functions``  column expressions (spans, text, geo, affect, statistics)
* ``operators``  relational operators (grounding, pooling, matching, agreement ...)
* ``sources``    readers and deterministic generators, plus sinks
* ``plans``      the registered queries and their ANSI-SQL counterparts
* ``streaming``  Structured Streaming variants
* ``llm``        operators for training-data pipelines (nothing else imports it)
"""

__version__ = "0.1.0"
