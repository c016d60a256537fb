"""patchlens: Spark-native analytics for code-change risk data.

Tables of commits, diffs and function bodies are cleaned, deduplicated,
profiled and turned into code metrics with native Column expressions;
splits, TF-IDF features, classifier training, evaluation, Shapley-value
explanations and a results table are all Spark jobs.

Sub-packages:
  sources/    readers, writers, report frames and the derived input views
  functions/  text and code metrics as Column expressions
  operators/  filters, profiling, sampling/splits, joins, metrics, TF-IDF,
              models and explanations
  plans/      end-to-end jobs composed from the operators
  streaming/  the row-level cleaning as an incremental file stream
"""

__version__ = "0.1.0"
