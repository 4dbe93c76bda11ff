"""tidegate: the data semantics of a JSON-RPC request/response service, on Spark DataFrames."""
