"""Analytics over document corpora and question-answering logs, on Spark DataFrames."""
