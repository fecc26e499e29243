"""Training-data operators over the tables documents, benchmark and labels."""
