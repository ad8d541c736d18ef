"""The batch job that writes every metric, and the dashboard views over them."""
