"""Log analytics on Spark: tokenize, mask, mine, enrich, query and flag."""
