"""tracelake: endpoint-forensics analytics on Spark DataFrames."""
