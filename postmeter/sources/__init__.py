"""Reading and guarded writing of tables."""
