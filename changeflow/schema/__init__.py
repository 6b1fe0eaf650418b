"""Table schemas in motion: changes, their application, differences, ALTER statements, dialects."""
