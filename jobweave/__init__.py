"""Analytics over semi-structured posting collections, written for Spark DataFrames."""
