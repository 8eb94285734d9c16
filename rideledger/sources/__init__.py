"""Source tables and the stored current and history areas."""
