"""mediacat: a catalogue-and-search engine for media and documents on Spark DataFrames."""
