"""Session-journal analytics on Spark: sources, operators, plans and streaming over coding-agent transcripts."""
