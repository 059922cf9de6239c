"""The analytic queries and the tables they maintain."""
