"""Column functions: text normalisation and terms, field extraction, legal citations."""
