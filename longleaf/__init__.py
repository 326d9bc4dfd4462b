"""A DataFrame engine for retrieval over long documents."""
