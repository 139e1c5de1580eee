"""wayfarer: journey analytics for event telemetry, planned by Catalyst."""
