"""framelake: imaging time series as Spark tables, with DataFrame, Arrow and streaming operators."""
