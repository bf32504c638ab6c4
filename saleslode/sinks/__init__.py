"""Writers: Bronze batches, overwritten datasets, tables, reports and run logs."""
