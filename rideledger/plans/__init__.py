"""What a user asks for: dashboards, control reports, exports and the sync job."""
