"""Plan building blocks: scratch tables and multi-step plans."""
