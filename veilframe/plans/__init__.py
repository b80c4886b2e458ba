"""What is decided before a job runs: rules, their store, and SQL scripts."""
