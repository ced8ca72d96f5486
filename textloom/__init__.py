"""textloom: text and web-data processing as ordinary Spark DataFrame and Column functions."""
