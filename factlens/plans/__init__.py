"""Named queries, the projection of test tables onto facts, and SQL for comparison."""
