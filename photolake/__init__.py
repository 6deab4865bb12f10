"""photolake: Spark jobs over very large photo libraries."""
