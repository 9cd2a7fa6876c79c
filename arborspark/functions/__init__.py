"""Column expressions: numeric rules, Fisher's exact test, letter-pair similarity."""
