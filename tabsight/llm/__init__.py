"""Training-data pipeline operators (documents, pages, embeddings).

Nothing else in the library imports this subpackage.  Every operator takes and returns
DataFrames; ``queries`` holds the thin registered queries and their SQL.

Conventions shared by all operators
-----------------------------------
* rows whose ``doc_id`` is null are kept and treated as one document that sorts before all others;
* null texts behave as described in each operator; nothing is dropped for being long, empty or repeated;
* only the named columns are read, so extra columns (also with clashing names) pass through untouched or are ignored;
* intermediate tables go below ``spark.checkpoint.dir`` and are removed once the next step is written.
"""
