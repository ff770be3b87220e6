"""DataFrame operators: flags, matching, dedupe, shares, trends, dictionaries, vocabulary,
samples and clusters. Every operator takes and returns DataFrames."""
