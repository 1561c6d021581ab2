"""corpuskiln: a PySpark-native engine for document corpora.

Chunks, references, citation graphs, vector and graph retrieval, evaluation
metrics and the data-quality operators of a large training corpus, all as
DataFrame plans.
"""
