"""quillspan: text retrieval and citation analytics on PySpark DataFrames."""
