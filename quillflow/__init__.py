"""quillflow: a Spark-native engine for transaction networks, event histories and model-score evaluation."""

__version__ = "0.1.0"
