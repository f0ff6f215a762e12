"""Named queries, their SQL counterparts, and the step registry."""
