"""Document-forensics and corpus engine on PySpark DataFrames."""
