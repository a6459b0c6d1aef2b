"""articlelab: article-classification table work as Spark jobs.

Sub-packages:

* ``sources``   - table, CSV, JSON, word-vector and image readers
* ``sinks``     - CSV / parquet / JSON writers, batch partitioned output
* ``functions`` - column expressions (text, names, vectors, images)
* ``operators`` - DataFrame -> DataFrame transformations (keys, sampling,
  labels, vocabulary, pooling, metrics, runs)
* ``train``     - distributed trainers (softmax regression, MLP, SAMME, word2vec)
* ``plans``     - job compositions and the query registry
* ``streaming`` - incremental (restartable) embedding with Structured Streaming
"""

from articlelab.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
