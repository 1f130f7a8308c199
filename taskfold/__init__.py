"""A registry of work items for many projects, kept and analysed with Spark."""
