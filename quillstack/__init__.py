"""quillstack: document analytics on Spark DataFrames."""
