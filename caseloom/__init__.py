"""Caseloom: listing, mutation, lookup, text, validation and state operators over personal-records tables, as Spark DataFrames."""
