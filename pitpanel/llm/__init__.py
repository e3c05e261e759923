"""Training-data operators: tokenizing, quality, de-duplication, mixing and page extraction over Spark tables."""
