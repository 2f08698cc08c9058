"""ledgerlake: tables, text and questions over business documents, on Spark."""
