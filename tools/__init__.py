"""Developer tools: oracle comparison."""
