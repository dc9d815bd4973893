"""Query plans: prompts, the model job, the curation loop and the registered queries."""
