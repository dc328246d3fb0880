"""numpy kernels and Column functions; nothing here starts a Spark job."""
