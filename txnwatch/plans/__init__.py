"""Table mappings, registered queries and their reference SQL."""
