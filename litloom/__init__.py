"""Literature analytics on Spark: DataFrame operators over records, texts, pages and decks."""
