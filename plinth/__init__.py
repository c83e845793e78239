"""Evidence-graph analytics on PySpark: graph, retrieval, grounding and metric operators as DataFrame plans."""

__version__ = "0.1.0"
