"""quarry — corpus search and patch analytics as plain Spark DataFrame jobs.

Sub-packages:

* ``sources``   — table / file / rule scans and instance selection.
* ``functions`` — Column-level helpers (tokenising, hashing, reply parsing,
  HTML to text, numbered lines).  Every helper returns a ``Column`` built from
  ``pyspark.sql.functions`` so it stays inside whole-stage codegen.
* ``operators`` — DataFrame -> DataFrame operators (chunking, inverted index,
  BM25 / L1 top-k, diff parsing, distributions, keyed cache, inference).
* ``plans``     — the registered queries: rendered inputs built from the
  driver tables plus the operators, and their DuckDB oracle SQL.
* ``streaming`` — incremental index maintenance with Structured Streaming.
"""

__version__ = "0.1.0"
