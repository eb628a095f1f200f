"""Query registry, oracle SQL and the materialized reference flow."""
