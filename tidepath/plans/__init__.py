"""Named queries over a folder of tables, their SQL twins, and the full job."""
