"""Full-text search with typo tolerance, boolean queries and proximity rating, as Spark plans."""
