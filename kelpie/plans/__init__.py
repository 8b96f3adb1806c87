"""Plans over several operators: registered queries, indexing and the search loop."""
