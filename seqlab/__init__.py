"""seqlab: Spark operators for ordered event histories and their honest evaluation."""
