"""tidemark: leak-safe analytics of event logs as plain Spark DataFrame operators."""
