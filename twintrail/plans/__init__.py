"""Reports that combine several operators."""
