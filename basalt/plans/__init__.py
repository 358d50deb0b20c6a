"""End-to-end plans, model providers and the registered queries."""
