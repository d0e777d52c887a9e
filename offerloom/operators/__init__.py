"""DataFrame to DataFrame jobs. Every job carries its grouping key as a column."""
