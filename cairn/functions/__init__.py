"""Column functions: text, similarity, scores, rules."""
