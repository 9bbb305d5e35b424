"""DataFrame operators of the KPI engine."""
