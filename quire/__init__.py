"""Document analytics over a corpus, as DataFrame -> DataFrame operators."""
