"""Heronry: document-retrieval analytics on Spark DataFrames.

Subpackages: ``sources`` (readers and sinks), ``functions`` (Column builders),
``operators`` (DataFrame -> DataFrame), ``plans`` (named queries and their SQL),
``streaming`` (stateful operators).  Nothing here imports ``heronry.llm``.
"""

__version__ = "0.1.0"
