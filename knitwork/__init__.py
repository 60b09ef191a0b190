"""knitwork: hypergraph message passing and corpus preparation on Spark DataFrames."""
