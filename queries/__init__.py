"""The registered queries, each with an equivalent SQL text where one exists."""
