"""weftline: reference graphs, retrieval and corpus integrity over text corpora, expressed in Spark DataFrames."""
