"""From a job's text to a running plan: configuration, jobs, command line."""
