"""Reading corpora and storing the tables."""
