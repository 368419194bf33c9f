"""Training-data operators: each module holds one operator over a documents table."""
