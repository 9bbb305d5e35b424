"""KPI definitions and table schemas."""
