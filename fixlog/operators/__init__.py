"""Rules as DataFrames, and the loop that closes recursive ones."""
