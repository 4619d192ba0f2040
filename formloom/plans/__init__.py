"""Driver-side compilation: schemas, rules, prompts."""
